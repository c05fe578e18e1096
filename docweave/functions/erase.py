"""Rectangles to clear before a page is set anew, as arrays of struct<x1, y1, x2, y2>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Box, clamp_rect, erase_rect, field_box, pixel_rect, stored_erase_rect

CELL_FONT, CELL_PAD, CELL_INSET, GRID_INSET = 10, 4, 3, 4


def span_box(corners: Column) -> Column:
    """Box of a span: x0, y0, x1, y1 where the third number is above the first, else x, y, w, h.
    Fewer than four numbers give null."""
    n = [F.get(corners, i) for i in range(4)]
    wide = n[2] > n[0]
    return F.when(F.size(corners) >= 4, F.struct(n[0].alias("x"), n[1].alias("y"), F.when(wide, n[2] - n[0]).otherwise(n[2]).alias("width"), F.when(wide, n[3] - n[1]).otherwise(n[3]).alias("height")))


def stored_rects(boxes: Column, font_size: Column, page_w: Column, page_h: Column) -> Column:
    return F.transform(F.coalesce(boxes, F.array().cast("array<struct<x:double,y:double,width:double,height:double>>")), lambda v: stored_erase_rect(field_box(v), font_size, page_w, page_h))


def text_rects(boxes: Column, b: Box, font_size: Column, page_w: Column, page_h: Column) -> Column:
    """Of a text block: its stored boxes, then the block as a whole."""
    return F.concat(stored_rects(boxes, font_size, page_w, page_h), F.array(erase_rect(b, F.coalesce(font_size, F.lit(12)), page_w, page_h)))


def tight_rects(boxes: Column, b: Box, font_size: Column, page_w: Column, page_h: Column) -> Column:
    """Of a text block: its stored boxes with a small margin; without any, the block less a thin border."""
    pad = F.greatest(F.lit(2), (F.coalesce(font_size, F.lit(12)) * 0.22).cast("int"))
    one = lambda v: clamp_rect(v["x"] - pad, v["y"] - pad, v["x"] + v["width"] + pad, v["y"] + v["height"] + pad, page_w, page_h)
    x, y, w, h = (v.cast("int") for v in b)
    dx, dy = F.greatest(F.lit(1), (w * 0.02).cast("int")), F.greatest(F.lit(1), (h * 0.06).cast("int"))
    whole = F.array(clamp_rect(x + dx, y + dy, x + w - dx, y + h - dy, page_w, page_h))
    return F.when(F.coalesce(F.size(boxes), F.lit(0)) > 0, F.transform(boxes, one)).otherwise(whole)


def _sizes(given: Column, n: Column, whole: Column) -> Column:
    """n sizes: the given ones, equal shares where they end."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(given, i).cast("double"), whole / n))


def _before(sizes: Column, i: Column) -> Column:
    return F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0.0), lambda a, v: a + v)


def grid_rects(rows: Column, b: Box, page_w: Column, page_h: Column, inset: int, col_widths: Column | None = None, row_heights: Column | None = None) -> Column:
    """Of each place of a table without cells of its own, row by row; no row or no column: empty."""
    none = F.lit(None).cast("array<double>")
    n, m = F.size(rows), F.array_max(F.transform(rows, F.size))
    x, y, w, h = (v.cast("int") for v in b)
    ws, hs = _sizes(none if col_widths is None else col_widths, m, w), _sizes(none if row_heights is None else row_heights, n, h)

    def at(r: Column, c: Column) -> Column:
        cx, cy = x + _before(ws, c), y + _before(hs, r)
        return clamp_rect(cx + inset, cy + inset, cx + F.get(ws, c) - inset, cy + F.get(hs, r) - inset, page_w, page_h)

    every = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.transform(F.sequence(F.lit(0), m - 1), lambda c: at(r, c))))
    return F.when((n > 0) & (m > 0), every).otherwise(F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>"))


def table_rects(cells: Column, rows: Column, b: Box, page_w: Column, page_h: Column, col_widths: Column | None = None, row_heights: Column | None = None) -> Column:
    """Of a table: its cells (struct of a box and font_size) widened, inside their borders; else the grid."""

    def one(v: Column) -> Column:
        pad = F.greatest(F.lit(CELL_PAD), (F.coalesce(v["font_size"], F.lit(CELL_FONT)) * 0.35).cast("int"))
        r = pixel_rect(field_box(v), page_w, page_h, pad, 0.05, 0.10)
        return clamp_rect(r["x1"] + CELL_INSET, r["y1"] + CELL_INSET, r["x2"] - CELL_INSET, r["y2"] - CELL_INSET, page_w, page_h)

    return F.when(F.size(cells) > 0, F.transform(cells, one)).otherwise(grid_rects(rows, b, page_w, page_h, CELL_INSET, col_widths, row_heights))


def cell_rects(cells: Column, rows: Column, b: Box, page_w: Column, page_h: Column) -> Column:
    """Of a table: the insides of its cells, or of an even grid."""

    def one(v: Column) -> Column:
        x, y, w, h = (v[c].cast("int") for c in ("x", "y", "width", "height"))
        return clamp_rect(x + GRID_INSET, y + GRID_INSET, x + w - GRID_INSET, y + h - GRID_INSET, page_w, page_h)

    return F.when(F.size(cells) > 0, F.transform(cells, one)).otherwise(grid_rects(rows, b, page_w, page_h, GRID_INSET))


def block_rects(kind: Column, of_text: Column, of_table: Column) -> Column:
    return F.when(kind == "table", of_table).otherwise(of_text)
