"""Answers of structure analysis (JSON text) brought to regions, paragraphs and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import as_struct, provider_box
from ..functions.text import blank, html_table_rows, strip
from .ingest import label_type

#: Keys under which the list of blocks may stand, and keys of a block's text; the first counts.
LISTS = ("parsing_res_list", "layout_res", "res", "blocks", "layout")
TEXTS = ("text", "content", "transcription", "rec_text")
INNER = ("text", "html", "content")
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CELL = "struct<row:int,row_idx:int,col:int,col_idx:int,text:string,content:string>"


def _at(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def _is(c: Column, sign: str) -> Column:
    return F.coalesce(F.startswith(F.ltrim(c), F.lit(sign)), F.lit(False))


def as_list(json: Column, key: str) -> Column:
    """array<string> of a field: the items of a list, a single value as one item, absent: empty."""
    v = _at(json, key)
    return F.when(_is(v, "["), F.from_json(v, "array<string>")).when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<string>"))


def provider_blocks(page: Column) -> Column:
    """array<string>: blocks (JSON objects) of a page answer; one that is a block itself is its only one."""
    none = F.array().cast("array<string>")
    out = F.when(F.lit(False), none)
    for k in LISTS:
        out = out.when(_is(_at(page, k), "["), F.filter(F.from_json(_at(page, k), "array<string>"), lambda b: _is(b, "{")))
    return out.when(_at(page, "bbox").isNotNull() | _at(page, "box").isNotNull(), F.array(page)).otherwise(none)


def block_text(block: Column) -> Column:
    """Text of a block: a text key that is not blank, else what res holds (object or list), else
    empty. Numbers count as text."""
    res = _at(block, "res")
    own = [F.when(~blank(_at(block, k)), _at(block, k)) for k in TEXTS]
    inner = F.when(_is(res, "{"), F.coalesce(*(_at(res, k) for k in INNER)))
    item = lambda x: F.when(_is(x, "{"), F.coalesce(*(F.when(_at(x, k) != "", _at(x, k)) for k in ("text", "content")))).otherwise(x)
    listed = F.when(_is(res, "["), F.array_join(F.filter(F.transform(F.from_json(res, "array<string>"), item), lambda x: x.isNotNull()), " "))
    return F.coalesce(*own, inner, listed, F.lit(""))


def table_rows(block: Column) -> Column:
    """array<array<string>> of a table block: from its cells, from HTML, or a row for each line;
    null where there is no text. Of two cells in one place the first counts."""
    res = F.coalesce(_at(block, "res"), _at(block, "html"), block)
    cells = F.when(_is(res, "{"), F.from_json(_at(res, "cells"), f"array<{CELL}>"))
    row, col = lambda c: F.coalesce(c["row"], c["row_idx"], F.lit(0)), lambda c: F.coalesce(c["col"], c["col_idx"], F.lit(0))
    last = lambda f: F.greatest(F.array_max(F.transform(cells, f)), F.lit(0))
    text = lambda c: F.coalesce(c["text"], c["content"], F.lit(""))
    place = lambda r, k: F.coalesce(F.get(F.transform(F.filter(cells, lambda c: (row(c) == r) & (col(c) == k)), text), 0), F.lit(""))
    dense = F.transform(F.sequence(F.lit(0), last(row)), lambda r: F.transform(F.sequence(F.lit(0), last(col)), lambda k: place(r, k)))
    lines = F.transform(F.filter(F.split(block_text(block), LINE_END), lambda t: ~blank(t)), lambda t: F.array(t))
    html = F.contains(F.lower(res), F.lit("<tr")) & ~_is(res, "{") & ~_is(res, "[")
    out = F.when(F.size(cells) > 0, dense).when(html, html_table_rows(res)).otherwise(lines)
    return F.when(F.size(out) > 0, out)


def block_box(block: Column, page_w: Column, page_h: Column) -> Column:
    """struct<x, y, width, height> of a block's box: an object, or four numbers, read as corners
    where they reach outside the page; null without any. x, y >= 0 and sizes >= 1."""
    raw = F.coalesce(_at(block, "bbox"), _at(block, "box"))
    number = lambda *keys: F.coalesce(*(_at(raw, k).cast("double") for k in keys), F.lit(0.0))
    x, y, w, h = number("x", "x1"), number("y", "y1"), number("width", "w"), number("height", "h")
    w = F.when((w <= 0) & _at(raw, "x2").isNotNull(), number("x2") - x).otherwise(w)
    h = F.when((h <= 0) & _at(raw, "y2").isNotNull(), number("y2") - y).otherwise(h)
    v = F.from_json(raw, "array<double>")
    listed = provider_box(v, (F.get(v, 2) > page_w) | (F.get(v, 3) > page_h))
    named = F.array(x, y, w, h)
    return F.when(_is(raw, "{"), as_struct(provider_box(named, F.lit(False)))).when(_is(raw, "[") & (F.size(v) >= 4), as_struct(listed))


def structure(pages: DataFrame, content: str, page_w: Column, page_h: Column) -> DataFrame:
    """One row a block that has a box: columns of pages, k, element_type, box, confidence, text, rows."""
    keep, block = [c for c in pages.columns if c != content], F.col("block")
    b = pages.withColumns({"dw_w": page_w, "dw_h": page_h}).select(*keep, "dw_w", "dw_h", F.posexplode(provider_blocks(F.col(content))).alias("k", "block"))
    b = b.withColumn("box", block_box(block, F.col("dw_w"), F.col("dw_h"))).where("box is not null")
    label = F.lower(F.coalesce(_at(block, "label"), _at(block, "type"), F.lit("text")))
    score = F.coalesce(_at(block, "score"), _at(block, "confidence")).cast("double")
    return b.select(*keep, "k", label_type(label).alias("element_type"), "box.*", score.alias("confidence"), F.when(label != "table", strip(block_text(block))).alias("text"), F.when(label == "table", table_rows(block)).alias("rows"))


def split_structure(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions, paragraphs with text, tables with rows) of structure(); confidence 0.9 or, of
    paragraphs, 0.85 where none is given."""
    sure = lambda d, v: d.withColumn("confidence", F.coalesce("confidence", F.lit(v)))
    return sure(found.drop("text", "rows"), 0.9), sure(found.where("text <> ''").drop("rows"), 0.85), found.where(F.col("rows").isNotNull()).drop("text")
