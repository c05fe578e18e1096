"""What a reader of documents is shown: confidences, warnings, sizes, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, scaled

#: Words of a warning that tells of a failure, and the mark of a page that was not read.
FAILURE = "(?i)failed|error|timeout|not installed|unavailable"
UNREAD = "OCR unavailable — install paddleocr"


def percent(value: Column, missing: str = "0%") -> Column:
    return F.coalesce(F.concat(F.round(value * 100).cast("int").cast("string"), F.lit("%")), F.lit(missing))


def shown_confidence(translation: Column, recognition: Column) -> Column:
    return percent(F.coalesce(translation, recognition), "—")


def failures(warnings: Column) -> Column:
    return F.filter(warnings, lambda w: w.rlike(FAILURE))


def other_warnings(warnings: Column) -> Column:
    return F.filter(warnings, lambda w: ~w.rlike(FAILURE))


def needs_reading(pages: DataFrame, blocks: DataFrame, text: str = "original_text", mark: str = UNREAD) -> DataFrame:
    """doc_id, needs_reading: no page has a raster or a block, or a block holds the mark."""
    per = blocks.groupBy("doc_id", "page_number").agg(F.max(F.contains(F.col(text), F.lit(mark))).alias("marked"))
    both = pages.select("doc_id", "page_number", "raster_path").join(per, ["doc_id", "page_number"], "full")
    empty = F.col("raster_path").isNull() & F.col("marked").isNull()
    return both.groupBy("doc_id").agg((F.min(empty) | F.coalesce(F.max("marked"), F.lit(False))).alias("needs_reading"))


def page_or_first(pages: DataFrame, number: int) -> DataFrame:
    """Of each document the page with that number, else its first."""
    return pages.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("page_number") == number, number)), F.min("page_number")).alias("page_number"))


def recent(documents: DataFrame, by: str, tie: str, n: int = 6) -> DataFrame:
    return documents.orderBy(F.desc(by), tie).limit(n)


def byte_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1 << 20)))


def status_text(status: Column) -> Column:
    """Underscores to blanks, the first letter of each word large."""
    words = F.transform(F.split(status, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    return F.array_join(words, " ")


def on_screen(b: Box, font_size: Column, zoom: float) -> dict[str, Column]:
    s = scaled(b, zoom)
    return {"x": s.x, "y": s.y, "width": s.w, "height": s.h, "font_size": font_size * zoom}
