"""Layout tables derived from the driver's tables by whole-number rules (page 612 x 792).

Each function returns a DataFrame; SQL holds the same tables for DuckDB, so a query and its
oracle start from equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_W, PAGE_H = 612, 792


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "original_text")).where(F.trim("original_text") != "")
    n, i = F.length("original_text"), F.col("i")
    slot = i % 12
    text = F.col("original_text")
    out = lines.select(
        "doc_id", "lang", "i", (F.floor(i / 12) + 1).cast("int").alias("page_number"), slot.alias("slot"),
        (40 + (slot % 2) * 280).alias("x"), (40 + F.floor(slot / 2).cast("int") * 120).alias("y"),
        (200 + (n % 5) * 12).alias("width"), (12 + F.least(F.floor(n / 24).cast("int"), F.lit(8)) * 11).alias("height"), (8 + n % 3).alias("font_size"),
        F.when(slot == 0, "heading").when(slot == 11, "footer").otherwise("paragraph").alias("layout_type"), "original_text",
        F.when(i % 5 == 1, text).when(i % 5 == 2, F.concat(F.lit("[t] "), text)).when(i % 5 >= 3, F.concat(text, F.lit(" "), text)).alias("translated_text"),
        ((50 + i % 50) / 100).alias("confidence"), F.when(i % 4 != 0, (60 + (i * 7) % 40) / 100).alias("translation_confidence"), (i % 7 == 0).alias("is_edited"),
    )
    return out


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).select("doc_id", "page_number", "i", "x", "y", "width", "height", "layout_type")
    i = F.col("i")

    def one(rid, x, y, w, h, kind):
        return F.struct(rid.cast("int").alias("rid"), x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("width"), h.cast("int").alias("height"), kind.alias("element_type"))

    def of_block(rid, dx, dy, kind):
        return one(rid, F.col("x") + dx, F.col("y") + dy, F.col("width"), F.col("height"), kind)

    own = F.array_compact(F.array(  # one pass over the blocks
        of_block(i, (i % 5) * 12, (i % 5) * 5, F.col("layout_type")), F.when(i % 3 == 0, of_block(200000 + i, F.lit(2), F.lit(1), F.lit("list"))),
        F.when(i % 4 == 1, of_block(300000 + i, (i % 5) * 12, (i % 5) * 5, F.lit("quote"))), F.when(i % 10 == 9, of_block(400000 + i, F.lit(1), F.lit(0), F.lit("table")))))
    page, fixed = F.col("page_number"), lambda *v: one(*map(F.lit, v))
    of_page = F.array_compact(F.array(F.when(page % 2 == 1, fixed(100000, 40, 40, 532, 700, "figure")), F.when(page % 5 == 0, fixed(100001, 320, 40, 252, 220, "table"))))
    pages = b.select("doc_id", "page_number").distinct().select("doc_id", "page_number", F.explode(of_page).alias("r"))
    return b.select("doc_id", "page_number", F.explode(own).alias("r")).union(pages).select("doc_id", "page_number", "r.*")


def html_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of pages.html in document order, stacked down the page."""
    kinds = {"h1": "title", "p": "paragraph", "li": "list", "nav": "header", "footer": "footer"}
    found = F.regexp_extract_all("html", F.lit(r"(?i)<(h1|p|li|nav|footer)[ >]"), F.lit(1))
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("k", "tag"))
    mapping = F.create_map(*(F.lit(v) for kv in kinds.items() for v in kv))
    return tags.select("page_id", "k", F.element_at(mapping, F.lower("tag")).alias("element_type"), F.lit(40).alias("x"), (F.col("k") * 24).alias("y"), F.lit(532).alias("width"), F.lit(20).alias("height"))


BLOCKS_SQL = """
fx_lines AS (SELECT doc_id, lang, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS original_text FROM documents),
fx_blocks AS (SELECT doc_id, lang, i::INT AS i, (i // 12 + 1)::INT AS page_number, (i % 12)::INT AS slot, (40 + ((i % 12) % 2) * 280)::INT AS x, (40 + ((i % 12) // 2) * 120)::INT AS y,
 (200 + (length(original_text) % 5) * 12)::INT AS width, (12 + least(length(original_text) // 24, 8) * 11)::INT AS height, (8 + length(original_text) % 3)::INT AS font_size,
 CASE WHEN i % 12 = 0 THEN 'heading' WHEN i % 12 = 11 THEN 'footer' ELSE 'paragraph' END AS layout_type, original_text,
 CASE i % 5 WHEN 0 THEN NULL WHEN 1 THEN original_text WHEN 2 THEN '[t] ' || original_text ELSE original_text || ' ' || original_text END AS translated_text,
 (50 + i % 50) / 100 AS confidence, CASE WHEN i % 4 = 0 THEN NULL ELSE (60 + (i * 7) % 40) / 100 END AS translation_confidence, i % 7 = 0 AS is_edited
 FROM fx_lines WHERE trim(original_text) <> '')"""

REGIONS_SQL = (
    BLOCKS_SQL
    + """,
fx_pages AS (SELECT DISTINCT doc_id, page_number FROM fx_blocks),
fx_regions AS (
 SELECT doc_id, page_number, i AS rid, x + (i % 5) * 12 AS x, y + (i % 5) * 5 AS y, width, height, layout_type AS element_type FROM fx_blocks
 UNION ALL SELECT doc_id, page_number, 100000, 40, 40, 532, 700, 'figure' FROM fx_pages WHERE page_number % 2 = 1
 UNION ALL SELECT doc_id, page_number, 100001, 320, 40, 252, 220, 'table' FROM fx_pages WHERE page_number % 5 = 0
 UNION ALL SELECT doc_id, page_number, 200000 + i, x + 2, y + 1, width, height, 'list' FROM fx_blocks WHERE i % 3 = 0
 UNION ALL SELECT doc_id, page_number, 300000 + i, x + (i % 5) * 12, y + (i % 5) * 5, width, height, 'quote' FROM fx_blocks WHERE i % 4 = 1
 UNION ALL SELECT doc_id, page_number, 400000 + i, x + 1, y, width, height, 'table' FROM fx_blocks WHERE i % 10 = 9)"""
)

HTML_SQL = """
fx_tags AS (SELECT page_id, unnest(range(len(regexp_extract_all(html, '(?i)<(h1|p|li|nav|footer)[ >]', 1)))) AS k, unnest(regexp_extract_all(html, '(?i)<(h1|p|li|nav|footer)[ >]', 1)) AS tag FROM pages),
fx_html AS (SELECT page_id, k::INT AS k, CASE lower(tag) WHEN 'h1' THEN 'title' WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'list' WHEN 'nav' THEN 'header' ELSE 'footer' END AS element_type, 40 AS x, (k * 24)::INT AS y, 532 AS width, 20 AS height FROM fx_tags)"""
