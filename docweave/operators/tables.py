"""Tables of documents: geometry, cell boxes, translation of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.text import blank

INSET = 3


def geometry(rows: Column, original: Column, b: Box) -> dict[str, Column]:
    """Equal column widths and row heights; rows grow where the text grew by more than a fifth."""
    cols, n = F.array_max(F.transform(rows, F.size)), F.size(rows)
    longest = F.array_max(F.transform(rows, lambda r: F.length(F.array_join(r, " "))))
    before = F.array_max(F.transform(original, lambda r: F.length(F.array_join(r, " "))))
    height = b.h / F.greatest(n, F.lit(1))
    grown = F.when((longest > before * 1.2) & (before > 0), F.greatest(height, height * longest / before)).otherwise(height)
    return {"col_widths": F.array_repeat(b.w / F.greatest(cols, F.lit(1)), cols), "row_heights": F.array_repeat(grown, n)}


def cell_rects(rows: Column, b: Box) -> Column:
    """array<struct<row, col, x1, y1, x2, y2>> of an even grid, inside its borders."""
    n, m = F.size(rows), F.array_max(F.transform(rows, F.size))
    x, y, w, h = (v.cast("int") for v in b)
    at = lambda r, c: F.struct(
        r.alias("row"), c.alias("col"), (x + w / m * c + INSET).cast("int").alias("x1"), (y + h / n * r + INSET).cast("int").alias("y1"),
        (x + w / m * (c + 1) - INSET).cast("int").alias("x2"), (y + h / n * (r + 1) - INSET).cast("int").alias("y2"))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.transform(F.sequence(F.lit(0), m - 1), lambda c: at(r, c))))


def cells(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, text, skip): every cell of tables (rows array of arrays); blank ones are not translated."""
    r = tables.select(*keys, F.posexplode("rows").alias("row", "cells")).select(*keys, "row", F.posexplode("cells").alias("col", "text"))
    return r.withColumn("skip", blank(F.col("text")))


def regroup(cells_: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """rows of each table from its cells, in order."""
    per = cells_.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", F.col(text).alias("t")))).alias("c"))
    per = per.select(*keys, "row", F.transform("c", lambda x: x["t"]).alias("c"))
    return per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "c"))).alias("r")).select(*keys, F.transform("r", lambda x: x["c"]).alias("rows"))


def translated_rows(tables: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Tables with translated_rows: answers (keys, row, col, translation) put in place; blank
    cells and empty answers keep the original."""
    got = cells(tables, keys).join(answers, [*keys, "row", "col"], "left")
    text = F.when(F.col("skip") | F.coalesce(blank(F.col("translation")), F.lit(True)), F.col("text")).otherwise(F.col("translation"))
    return tables.join(regroup(got.withColumn("new_text", text), keys, "new_text").withColumnRenamed("rows", "translated_rows"), keys, "left")


def differs(rows: Column, translated: Column) -> Column:
    return ~rows.eqNullSafe(translated)


def preview(rows: Column, size: int = 200) -> Column:
    return F.substring(F.array_join(F.flatten(rows), " · "), 1, size)
