"""Page analysis by rules: sections, columns, captions, headers and region attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, iou
from ..functions.style import DECORATIVE, IMPORTANCE, hierarchy_level, lookup, region_alignment, region_font_size

CAPTION_REACH, CAPTION_IOU, HEADER_LINKS = 200, 0.3, 3


def attributes(regions: DataFrame, page_w: Column | float) -> DataFrame:
    kind, b = F.col("element_type"), box()
    return regions.withColumns({
        "importance": lookup(kind, IMPORTANCE, 0.5), "hierarchy_level": hierarchy_level(kind), "alignment": region_alignment(b, page_w),
        "estimated_font_size": region_font_size(kind, b.h), "is_decorative": kind.isin(*DECORATIVE)})


def sections(regions: DataFrame, page: list[str], tie: str) -> DataFrame:
    """section (from 0) of each region in (y, x) order; a title or heading starts one, and so
    does a first region that is neither. section_kind and level are those of its start."""
    starts = F.col("element_type").isin("title", "heading")
    w = Window.partitionBy(*page).orderBy("y", "x", tie)
    numbered = regions.withColumn("first", F.row_number().over(w) == 1).withColumn("section", F.sum((starts | F.col("first")).cast("int")).over(w) - 1)
    head = F.first(starts).over(Window.partitionBy(*page, "section").orderBy("y", "x", tie))
    return numbered.withColumn("headed", head).withColumn("section_kind", F.when(F.col("headed"), "heading").otherwise("paragraph")).withColumn("level", F.col("headed").cast("int")).drop("first", "headed")


def columns(regions: DataFrame, page: list[str], page_w: float) -> DataFrame:
    """column_count (2 with three centres or more on either side) and column_index of each region."""
    center, mid = F.col("x") + F.col("width") / 2, page_w / 2
    w = Window.partitionBy(*page)
    left, right = F.sum((center < mid * 0.9).cast("int")).over(w), F.sum((center > mid * 1.1).cast("int")).over(w)
    out = regions.withColumn("column_count", F.when((left >= 3) & (right >= 3), 2).otherwise(1))
    return out.withColumn("column_index", F.when((F.col("column_count") > 1) & (center > mid), 1).otherwise(0))


def caption_links(regions: DataFrame, page: list[str], tie: str) -> DataFrame:
    """Each caption with its nearest figure or image above it: page, caption, figure, distance."""
    c = regions.where("element_type = 'caption'").alias("l")
    f = regions.where(F.col("element_type").isin("figure", "image")).alias("r")
    on = F.lit(True)
    for p in page:
        on = on & (F.col(f"l.{p}") == F.col(f"r.{p}"))
    dist = F.abs(F.col("l.y") - (F.col("r.y") + F.col("r.height"))) + F.abs(F.col("l.x") - F.col("r.x"))
    pairs = c.join(f, on).withColumn("distance", dist.cast("double")).where((F.col("distance") < CAPTION_REACH) & (iou(box(of="l"), box(of="r")) < CAPTION_IOU))
    w = Window.partitionBy(*(F.col(f"l.{p}") for p in page), F.col(f"l.{tie}")).orderBy("distance", F.col("r.y"), F.col("r.x"), F.col(f"r.{tie}"))
    return pairs.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(*(F.col(f"l.{p}").alias(p) for p in page), F.col(f"l.{tie}").alias("caption"), F.col(f"r.{tie}").alias("figure"), "distance")


def header_links(regions: DataFrame, page: list[str], tie: str) -> DataFrame:
    """Each header with the first three body regions below it. One window a page: the body's
    regions number upwards in (y, x) order, so a header's are the next numbers after its y."""
    r = regions.where(~F.col("element_type").isin("footer", "logo")).withColumn("is_body", F.col("element_type") != "header")
    upto = Window.partitionBy(*page).orderBy("y").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.partitionBy(*page, "is_body").orderBy("y", "x", tie)
    r = r.withColumn("above", F.sum(F.col("is_body").cast("int")).over(upto)).withColumn("n", F.row_number().over(order))
    heads = r.where(~F.col("is_body")).select(*page, F.col(tie).alias("header"), F.posexplode(F.sequence(F.col("above") + 1, F.col("above") + HEADER_LINKS)).alias("k", "n"))
    body = r.where("is_body").select(*page, F.col(tie).alias("body"), F.col("n").cast("long").alias("n"))
    return heads.join(body, [*page, "n"]).select(*page, "header", "body", (F.col("k") + 1).alias("rank"))


def document_map(regions: DataFrame, page: list[str], tie: str, page_w: float) -> DataFrame:
    """Attributes, columns and sections together, one row a region."""
    return sections(columns(attributes(regions, page_w), page, page_w), page, tie)


def section_members(numbered: DataFrame, page: list[str], tie: str) -> DataFrame:
    """One row a section of sections(): page, section, title (text of its heading, where regions have a
    text) and members in (y, x) order."""
    title = F.min_by("text", F.struct("y", "x", tie)) if "text" in numbered.columns else F.lit(None).cast("string")
    got = numbered.groupBy(*page, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.col(tie).alias("id")))), lambda m: m["id"]).alias("members"), F.max("section_kind").alias("section_kind"), title.alias("title"))
    return got.withColumn("title", F.when(F.col("section_kind") == "heading", F.col("title")))


def blocks_by_section(blocks: DataFrame, members: DataFrame, page: list[str], tie: str) -> DataFrame:
    """Blocks of each section with its number and title; blocks of none are left out."""
    of = members.select(*page, "section", "title", F.posexplode("members").alias("place", tie))
    return blocks.join(of, [*page, tie])


def with_vision(blocks: DataFrame, analysed: DataFrame, page: list[str], region: str, columns_: list[str]) -> DataFrame:
    """Blocks with the analysis of their region, by its id; blocks without one keep nulls."""
    return blocks.join(analysed.select(*page, region, *columns_), [*page, region], "left")


def merge_hints(regions: DataFrame, hints: DataFrame, page: list[str], tie: str, page_w: float) -> DataFrame:
    """document_map() rows with a model's hints: hints has one row a page with column_count and
    notes array<struct<index, importance, hierarchy_level>>; index counts regions in (y, x) order.
    The last note on a region counts; pages and fields without a hint stay."""
    n = F.row_number().over(Window.partitionBy(*page).orderBy("y", "x", tie)) - 1
    got = regions.withColumn("dw_n", n).join(hints.select(*page, F.col("column_count").alias("dw_columns"), F.col("notes").alias("dw_notes")), page, "left")
    own = F.filter("dw_notes", lambda v: v["index"] == F.col("dw_n"))
    last = lambda f: F.get(F.reverse(F.filter(F.transform(own, lambda v: v[f]), lambda v: v.isNotNull())), 0)
    count = F.when(F.col("dw_columns") > 0, F.col("dw_columns")).otherwise(F.col("column_count"))
    center = F.col("x") + F.col("width") / 2
    out = got.withColumns({"importance": F.coalesce(last("importance"), "importance"), "hierarchy_level": F.coalesce(last("hierarchy_level"), "hierarchy_level"),
        "column_index": F.when(F.col("dw_notes").isNull() & F.col("dw_columns").isNull(), F.col("column_index")).otherwise(F.when((count > 1) & (center > page_w / 2), 1).otherwise(0)), "column_count": count})
    return out.drop("dw_n", "dw_columns", "dw_notes")
