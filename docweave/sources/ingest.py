"""Provider payloads brought to the engine's tables: spans, detections, regions, tables, cache rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import from_corners, from_polygon, scaled
from ..functions.style import color_hex
from ..functions.text import blank, strip

#: Detector class names, the first that a name contains counts; labels of structure analysis.
CLASS_NAMES = {"title": "heading", "text": "paragraph", "plain text": "paragraph", "paragraph": "paragraph", "table": "table", "list": "list", "figure": "figure", "image": "image", "logo": "logo", "header": "header", "footer": "footer", "caption": "caption", "sidebar": "sidebar", "quote": "quote"}
LABELS = {"title": "title", "text": "paragraph", "paragraph": "paragraph", "figure": "figure", "figure_caption": "caption", "table": "table", "table_caption": "caption", "header": "header", "footer": "footer", "reference": "paragraph", "equation": "paragraph", "formula": "paragraph", "list": "list", "image": "image"}
#: Pairs of the offline translator.
PIVOT, PARTNERS = "en", "es fr de it pt nl pl ru zh ja ar".split()


def element_type(class_name: Column) -> Column:
    out = F.when(F.lit(False), F.lit("unknown"))
    for name, kind in CLASS_NAMES.items():
        out = out.when(F.contains(F.lower(class_name), F.lit(name)), F.lit(kind))
    return out.otherwise(F.lit("unknown"))


def label_type(label: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in LABELS.items() for v in kv)), F.lower(label)), F.lit("unknown"))


def spans(raw: DataFrame, dpi: float = 300) -> DataFrame:
    """Text spans (text, x0, y0, x1, y1, size, font, flags, color at 72 dpi) in pixels, with
    weight, style, family without its subset prefix and #rrggbb; blank ones left out."""
    name, flags = F.lower(F.coalesce("font", F.lit(""))), F.coalesce("flags", F.lit(0))
    b = scaled(from_corners(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), dpi / 72)
    bold = (flags.bitwiseAND(F.lit(16)) != 0) | F.contains(name, F.lit("bold"))
    italic = (flags.bitwiseAND(F.lit(2)) != 0) | name.rlike("italic|oblique")
    return raw.where(~blank(F.col("text"))).withColumns({
        "text": strip(F.col("text")), "x": b.x, "y": b.y, "width": b.w, "height": b.h, "font_size": F.coalesce("size", F.lit(12.0)) * (dpi / 72),
        "font_family": F.element_at(F.split("font", r"\+"), -1), "color": color_hex(F.col("color")),
        "font_weight": F.when(bold, "bold").otherwise("normal"), "font_style": F.when(italic, "italic").otherwise("normal")})


def detections(raw: DataFrame) -> DataFrame:
    """OCR detections (text, confidence, points array<struct<x,y>>) as boxes, without blank or flat ones."""
    b = from_polygon(F.col("points"))
    return raw.withColumns({"x": b.x, "y": b.y, "width": b.w, "height": b.h}).where(~blank(F.col("text")) & (F.col("width") > 0) & (F.col("height") > 0))


def with_fallback_region(pages: DataFrame, regions: DataFrame, margin: float = 40) -> DataFrame:
    """Regions, and for a page without any one paragraph region inside a margin."""
    none = pages.join(regions.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
    made = none.select("doc_id", "page_number", F.lit(0).alias("rid"), F.lit(margin).alias("x"), F.lit(margin).alias("y"), (F.col("width") - 2 * margin).alias("width"), (F.col("height") - 2 * margin).alias("height"), F.lit("paragraph").alias("element_type"))
    return regions.select(*made.columns).unionByName(made)


def with_unread_marker(pages: DataFrame, paragraphs: DataFrame, reason: str) -> DataFrame:
    """Paragraphs, and for a page without any a marker of confidence 0."""
    none = pages.join(paragraphs.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
    made = none.select("doc_id", "page_number", F.lit(f"[OCR unavailable — {reason}]").alias("text"), F.lit(0.0).alias("confidence"))
    return paragraphs.select(*made.columns).unionByName(made)


def source_paragraphs(by_structure: DataFrame, by_region: DataFrame, whole: DataFrame, regions: DataFrame) -> DataFrame:
    """For each page: structure paragraphs if it has no regions and they exist, region-scoped ones if
    it has regions, else those of the whole page."""
    page = ["doc_id", "page_number"]
    has = regions.select(*page).distinct()
    a = by_structure.join(has, page, "left_anti")
    b = by_region.join(has, page, "left_semi")
    done = a.select(*page).union(b.select(*page)).distinct()
    return a.unionByName(b).unionByName(whole.join(done, page, "left_anti"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))


def without_documents(table: DataFrame, deleted: DataFrame) -> DataFrame:
    return table.join(deleted.select("doc_id"), "doc_id", "left_anti")


def upload_of(files: DataFrame) -> DataFrame:
    """One file for each document: the first by path."""
    return files.groupBy("doc_id").agg(F.min("path").alias("path"))


def read_settings(spark: SparkSession, path: str, schema: str, defaults: dict) -> dict:
    """Settings of a JSON file (one small row); a missing or broken file gives the defaults."""
    try:
        row = spark.read.schema(schema).json(path, multiLine=True).first()
    except Exception:  # noqa: BLE001  an unreadable file counts as absent
        row = None
    return defaults | {k: v for k, v in (row.asDict() if row else {}).items() if v is not None}


def write_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("stage").parquet(path)


def json_round_trip(c: Column, schema: str) -> Column:
    return F.from_json(F.to_json(c), schema)


def batch_answers(content: Column, expected: Column) -> Column:
    """array<string> of a batch answer in any of its three shapes, null if it is not complete."""
    whole = F.from_json(content, "array<string>")
    listed = F.from_json(F.get_json_object(content, "$.translations"), "array<string>")
    keyed = F.from_json(F.get_json_object(content, "$.translations"), "array<struct<id:int,text:string,translation:string,output:string>>")
    text = lambda x: strip(F.coalesce(*(F.when(~blank(x[k]), x[k]) for k in ("text", "translation", "output"))))
    by_id = F.map_from_entries(F.filter(F.transform(keyed, lambda x: F.struct(x["id"].alias("k"), text(x).alias("v"))), lambda e: e["k"].isNotNull() & e["v"].isNotNull()))
    order = F.transform(F.sequence(F.lit(0), expected - 1), lambda i: F.element_at(by_id, i))
    plain = lambda xs: F.when((F.size(xs) == expected) & F.forall(xs, lambda x: x.isNotNull() & ~F.startswith(x, F.lit("{"))), F.transform(xs, strip))
    full = F.when((F.size(F.map_keys(by_id)) == expected) & F.forall(order, lambda x: x.isNotNull()), order)
    return F.coalesce(F.when(F.startswith(F.ltrim(content), F.lit("[")), plain(whole)), F.when(F.get_json_object(content, "$.translations[0].id").isNull(), plain(listed)), F.when(F.get_json_object(content, "$.translations[0].id").isNotNull(), full))


def supported_pair(source: Column, target: Column) -> Column:
    return ((source == PIVOT) & target.isin(*PARTNERS)) | ((target == PIVOT) & source.isin(*PARTNERS))
