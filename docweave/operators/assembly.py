"""Lines, paragraphs and word places from recognised text: grouped sums, ordered inside a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, tokens


def _union() -> list[Column]:
    """Bounding box of the boxes of a group."""
    x, y = F.min("x"), F.min("y")
    return [x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("width")) - x).alias("width"), (F.max(F.col("y") + F.col("height")) - y).alias("height")]


def _joined(order: list[str], text: str) -> Column:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, strip(F.col(text)).alias("t")))), lambda s: s["t"])
    return F.array_join(F.filter(parts, lambda t: t != ""), " ")


def build_lines(detections: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """One row a line (keys): texts in order with a blank between, mean confidence, box around all."""
    return detections.groupBy(*keys).agg(_joined(order, text).alias("text"), F.avg("confidence").alias("confidence"), *_union())


def build_paragraphs(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a paragraph: lines in order, the mean of the lines' means, box around all, number of lines."""
    return lines.groupBy(*keys).agg(_joined(order, "text").alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_lines"), *_union())


def paragraph_score(text: Column, n_lines: Column, confidence: Column) -> Column:
    return F.length(text) + 12 * n_lines + 4 * F.size(tokens(text)) + 10 * confidence


def word_places(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Words of each line (keys) with k, x and w: placed by their length, 0.35 for the blank after
    all but the last. By window, so linear in the words of a line; weights in hundredths, so that
    sums are exact."""
    b = lines.withColumn("ws", tokens(F.col(text)))
    e = b.select(*keys, "x", "width", F.size("ws").alias("n"), F.posexplode("ws").alias("k", "word"))
    e = e.withColumn("wt", F.length("word") * 100 + F.when(F.col("k") < F.col("n") - 1, 35).otherwise(0))
    line = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("wt").over(line.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("wt").over(line)
    return e.select(*keys, "k", "word", F.round(F.col("x") + F.col("width") * before / total, 6).alias("x"), F.round(F.col("width") * F.col("wt") / total, 6).alias("w"))


def running_offsets(sizes: Column) -> Column:
    """0, then the sums of the first, the first two, ... of an array of sizes."""
    start = F.array(F.lit(0.0))
    return F.aggregate(sizes, start, lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))


def duplicate_orders(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Groups in which an order number comes twice."""
    n = blocks.groupBy(*keys).agg(F.count(order).alias("n"), F.countDistinct(order).alias("n_distinct"))
    return n.where("n <> n_distinct")
