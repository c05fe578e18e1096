"""Blocks of documents: filters, order, context, batches, joins by key, review, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.style import TEXT_REGIONS
from ..functions.text import blank, detect_language, strip

PAGE = ["doc_id", "page_number"]
#: Kinds of files that are taken.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff")
MIME = ("application/pdf", "image/png", "image/jpeg", "image/jpg", "image/tiff")


def admit_uploads(files: DataFrame, max_bytes: int = 50 << 20) -> DataFrame:
    """files (path, mime, length) with reason: null if the upload is admitted."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("reason", F.when(~ext.isin(*EXTENSIONS), "extension").when(~F.col("mime").isin(*MIME), "type").when(F.col("length") > max_bytes, "size"))


def translation_targets(blocks: DataFrame, skip_edited: bool = True, ids: list | None = None, pages: list[int] | None = None, id_col: str = "i") -> DataFrame:
    """Blocks to translate; an empty list of ids or pages filters nothing."""
    out = blocks.where(~F.col("is_edited")) if skip_edited else blocks
    out = out.where(F.col(id_col).isin(list(ids))) if ids else out
    return out.where(F.col("page_number").isin(list(pages))) if pages else out


def of_type(blocks: DataFrame, *kinds: str) -> DataFrame:
    return blocks.where(F.col("layout_type").isin(*kinds))


def reading_order(blocks: DataFrame, *tie: str) -> DataFrame:
    """reading_order from 0 on each page, by y, x and the order of emission."""
    return blocks.withColumn("reading_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y", "x", *tie)) - 1)


def with_context(rows: DataFrame, text: str, partition: list[str], order: list[str], size: int = 120) -> DataFrame:
    """prev_text and next_text: the first size characters of the neighbours in document order."""
    w = Window.partitionBy(*partition).orderBy(*order)
    head = F.substring(text, 1, size)
    return rows.withColumns({"prev_text": F.lag(head).over(w), "next_text": F.lead(head).over(w)})


def batches(blocks: DataFrame, order: list[str], size: int = 10) -> DataFrame:
    return blocks.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)) - 1) / size).cast("int"))


def translation_stats(blocks: DataFrame, by: list[str]) -> DataFrame:
    done = ~blank(F.col("translated_text"))
    same = done & (strip(F.col("translated_text")) == strip(F.col("original_text")))
    return blocks.groupBy(*by).agg(F.count("*").alias("total"), F.sum(done.cast("int")).alias("translated"), F.sum(same.cast("int")).alias("unchanged"))


def review_flags(blocks: DataFrame, source: Column, target: Column, least: float = 0.7) -> DataFrame:
    """needs_review, edited, unchanged, overflow, reviewed, highlight and text_differs of each block."""
    conf, text = F.col("translation_confidence"), F.col("translated_text")
    none = F.coalesce(text, F.lit("")) == ""
    return blocks.withColumns({
        "needs_review": F.coalesce(conf < least, F.lit(False)) | none,
        "edited": F.col("is_edited"),
        "unchanged": F.coalesce(strip(text) == strip(F.col("original_text")), F.lit(False)) & (source != target),
        "reviewed": F.col("is_edited") | (F.coalesce(conf, F.lit(1.0)) >= least),
        "highlight": F.coalesce(conf < least, F.lit(False)),
        "text_differs": text.isNotNull() & (strip(text) != strip(F.col("original_text"))),
    })


def apply_updates(blocks: DataFrame, updates: DataFrame, keys: list[str], columns: list[str], version: str) -> DataFrame:
    """blocks with the last update (by version) of each key; updated ones count as edited."""
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(version)).alias("new"))
    renamed = last.select(*keys, *(F.col(f"new.{c}").alias(f"new_{c}") for c in columns), F.lit(True).alias("hit"))
    out = blocks.join(renamed, keys, "left")
    out = out.withColumns({c: F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns})
    return out.withColumn("is_edited", F.coalesce("hit", F.lit(False)) | F.col("is_edited")).select(*blocks.columns)


def cache_probe(work: DataFrame, cache: DataFrame, keys: list[str], value: str, computed: Column) -> DataFrame:
    """value from the cache where its keys are known, else computed; and whether it was a hit."""
    known = cache.select(*keys, F.col(value).alias("cached"), F.lit(True).alias("hit")).dropDuplicates(keys)
    out = work.join(known, keys, "left")
    return out.withColumn(value, F.when(F.col("hit"), F.col("cached")).otherwise(computed)).withColumn("cache_hit", F.coalesce("hit", F.lit(False))).drop("cached", "hit")


def dense_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """rows (array of arrays) of each table from its cells (row, col, text); missing cells are empty,
    of two cells in one place the first text wins."""
    grid = cells.groupBy(*keys).agg(F.max("row").alias("r"), F.max("col").alias("c"), F.array_sort(F.collect_list(F.struct("row", "col", "text"))).alias("of"))
    at = lambda r, c: F.coalesce(F.get(F.filter("of", lambda x: (x["row"] == r) & (x["col"] == c)), 0)["text"], F.lit(""))
    return grid.select(*keys, F.transform(F.sequence(F.lit(0), F.col("r")), lambda r: F.transform(F.sequence(F.lit(0), F.col("c")), lambda c: at(r, c))).alias("rows"))


def born_digital(spans: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text", least_spans: int = 3, least_chars: int = 40) -> DataFrame:
    """Documents with born_digital: enough pages (half, one at least) hold enough text spans."""
    pages = spans.groupBy(doc, page).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))
    good = ((F.col("n") >= least_spans) & (F.col("chars") >= least_chars)).cast("int")
    return pages.groupBy(doc).agg(F.count("*").alias("pages"), F.sum(good).alias("good_pages")).withColumn("born_digital", F.col("good_pages") >= F.greatest(F.lit(1), F.floor(F.col("pages") / 2)))


def pages_of(rows: DataFrame, pages: list[int] | None) -> DataFrame:
    """Rows of the given pages; none given: all."""
    return rows.where(F.col("page_number").isin(list(pages))) if pages else rows


def text_regions(regions: DataFrame) -> DataFrame:
    return regions.where(F.col("element_type").isin(*TEXT_REGIONS))


def paint_order(blocks: DataFrame, *tie: str) -> DataFrame:
    """paint_order from 0 on each page: lower layers first, then reading order."""
    return blocks.withColumn("paint_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy("z_index", "reading_order", *tie)) - 1)


def batch_failures(translated: DataFrame) -> DataFrame:
    """doc_id, blocks, failed: blocks whose translation failed, summed over a document's batches."""
    return translated.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.col("failed").cast("int")).alias("failed"))


def qa_sample(blocks: DataFrame, order: list[str], id_col: str, share: float = 0.2, least: int = 3) -> DataFrame:
    """A reproducible share of each document's blocks; where it takes none, the first few."""
    hit = F.pmod(F.xxhash64("doc_id", id_col), F.lit(1000)) < int(share * 1000)
    doc = Window.partitionBy("doc_id")
    own = blocks.withColumn("dw_hit", hit).withColumn("dw_any", F.max("dw_hit").over(doc)).withColumn("dw_n", F.row_number().over(doc.orderBy(*order)))
    return own.where(F.col("dw_hit") | (~F.col("dw_any") & (F.col("dw_n") <= least))).drop("dw_hit", "dw_any", "dw_n")


def document_language(blocks: DataFrame, order: list[str], text: str = "original_text") -> DataFrame:
    """doc_id, language of the texts of its blocks in order, a line each."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("dw_t")))), lambda s: s["dw_t"]), "\n")
    return blocks.groupBy("doc_id").agg(joined.alias("t")).select("doc_id", detect_language(F.col("t")).alias("language"))


def rebuilt_share(pages: DataFrame) -> DataFrame:
    """doc_id, rebuilt, page_count: pages that have a translated raster, of all."""
    return pages.groupBy("doc_id").agg(F.count("translated_path").alias("rebuilt"), F.count("*").alias("page_count"))
