"""Joins of boxes on a page. Every join has an equality on the page and a cheap overlap test;
IoU is worked out after it. Ties go to the earliest in list order, by window rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, center_inside, containment, iou, overlaps

PAGE = ["doc_id", "page_number"]
INSIDE = 0.45


def overlap_pairs(left: DataFrame, right: DataFrame, how: str = "inner", page: list[str] = PAGE) -> DataFrame:
    """Pairs of overlapping boxes of a page, aliased l and r, with their iou."""
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in page] + [overlaps(box(of="l"), box(of="r"))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.alias("l").join(right.alias("r"), cond, how).withColumn("iou", F.coalesce(iou(box(of="l"), box(of="r")), F.lit(0.0)))


def match_region(blocks: DataFrame, regions: DataFrame, key: str, least: float = 0.15) -> DataFrame:
    """Each block with the region of greatest IoU (least or more; ties: smallest rid):
    page, key, rid, iou, element_type; nulls where none is near enough."""
    pairs = overlap_pairs(blocks, regions).where(F.col("iou") >= least)
    best = F.max_by(F.struct("r.rid", "iou", "r.element_type"), F.struct("iou", -F.col("r.rid")))  # partial before the shuffle
    top = pairs.groupBy(*(F.col(f"l.{c}") for c in PAGE), F.col(f"l.{key}")).agg(best.alias("best")).select(*PAGE, key, "best.*")
    return blocks.select(*PAGE, key).join(top, [*PAGE, key], "left")


def first_match(left: DataFrame, right: DataFrame, key: str, rank: str, least: float, strict: bool = False) -> DataFrame:
    """Each left row with the first right row (by rank) whose IoU reaches least."""
    ok = F.col("iou") > least if strict else F.col("iou") >= least
    found = overlap_pairs(left, right).where(ok).groupBy(*(F.col(f"l.{c}") for c in PAGE), F.col(f"l.{key}")).agg(F.min(F.col(f"r.{rank}")).alias(rank))
    return left.select(*PAGE, key).join(found, [*PAGE, key], "left")


def not_covered(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Rows of left that no right box covers with IoU of least or more."""
    l, r = box(of="l"), box(of="r")
    cond = (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.page_number") == F.col("r.page_number")) & overlaps(l, r) & (iou(l, r) >= least)
    return left.alias("l").join(right.alias("r"), cond, "left_anti")


def emit_images(images: DataFrame, paragraphs: DataFrame, page_area: Column | float, text: str = "original_text") -> DataFrame:
    """image regions with n_inside, chars_inside and emit: whether to keep them as pictures,
    by their share of the page and the text inside."""
    l, r = box(of="l"), box(of="r")
    cond = (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.page_number") == F.col("r.page_number")) & overlaps(l, r) & (containment(r, l) >= INSIDE)
    keys = [*PAGE, "rid", "x", "y", "width", "height"]
    inside = images.alias("l").join(paragraphs.alias("r"), cond, "left").groupBy(*(F.col(f"l.{c}") for c in keys)).agg(
        F.count(F.col("r.doc_id")).alias("n_inside"), F.coalesce(F.sum(F.length(F.col(f"r.{text}"))), F.lit(0)).alias("chars_inside"))
    area = F.lit(page_area) if not isinstance(page_area, Column) else page_area
    ratio = F.greatest(F.col("width") * F.col("height"), F.lit(1)) / F.greatest(area, F.lit(1))
    n, chars = F.col("n_inside"), F.col("chars_inside")
    drop = F.when(ratio >= 0.30, (n >= 2) | (chars >= 60)).otherwise((n >= 4) | (chars >= 120))
    return inside.withColumn("emit", (ratio < 0.06) | (n == 0) | ~drop)


def assign_regions(regions: DataFrame, paragraphs: DataFrame, key: str, least: float = 0.35) -> DataFrame:
    """Page, key, rid of each paragraph that a region takes (rid) or that is left over (rid null).

    A region takes its best paragraph by IoU, raised to least where the paragraph's centre is
    inside; a paragraph taken twice appears once, with its first region; one that overlaps
    least or more without being taken is dropped."""
    l, r = box(of="l"), box(of="r")
    pairs = overlap_pairs(regions, paragraphs)
    score = F.greatest(F.col("iou"), F.when(center_inside(r, l), F.lit(least)).otherwise(F.lit(0.0)))
    best = Window.partitionBy("l.doc_id", "l.page_number", "l.rid").orderBy(F.desc("score"), F.col(f"r.{key}"))
    taken = pairs.withColumn("score", score).where(F.col("score") >= least).withColumn("rank", F.row_number().over(best)).where("rank = 1")
    first = Window.partitionBy("doc_id", "page_number", key).orderBy("ry", "rx", "rid")
    taken = taken.select("l.doc_id", "l.page_number", F.col(f"r.{key}").alias(key), "l.rid", F.col("l.y").alias("ry"), F.col("l.x").alias("rx")).withColumn("rank", F.row_number().over(first)).where("rank = 1").select(*PAGE, key, "rid")
    rest = not_covered(paragraphs, regions, least).select(*PAGE, key).join(taken, [*PAGE, key], "left_anti").withColumn("rid", F.lit(None).cast("int"))
    return taken.unionByName(rest)


def table_rows(tables: DataFrame, paragraphs: DataFrame, key: str, text: str = "original_text", least: float = 0.15) -> DataFrame:
    """One-column rows of each table region: texts of the paragraphs on it, or one blank."""
    l, r = box(of="l"), box(of="r")
    cond = (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.page_number") == F.col("r.page_number")) & overlaps(l, r) & (iou(l, r) >= least)
    got = tables.alias("l").join(paragraphs.alias("r"), cond, "left").groupBy("l.doc_id", "l.page_number", "l.rid").agg(F.array_sort(F.collect_list(F.when(F.col(f"r.{key}").isNotNull(), F.struct(F.col(f"r.{key}").alias("k"), F.col(f"r.{text}").alias("t"))))).alias("of"))
    rows = F.transform("of", lambda x: x["t"])
    return got.select(*PAGE, "rid", F.when(F.size("of") > 0, rows).otherwise(F.array(F.lit(" "))).alias("rows"))


def page_boxes(df: DataFrame, *fields: str) -> DataFrame:
    """Boxes of each page as one array 'boxes', for the folds in grouping."""
    return df.groupBy(*PAGE).agg(F.collect_list(F.struct(*fields)).alias("boxes"))
