"""Box geometry as Column expressions; a box is (x, y, w, h), origin top left."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column


def box(prefix: str = "", of: str = "") -> Box:
    """Columns x, y, width, height with a prefix, of a table alias."""
    at = f"{of}." if of else ""
    return Box(*(F.col(f"{at}{prefix}{c}") for c in ("x", "y", "width", "height")))


def field_box(s: Column) -> Box:
    return Box(s["x"], s["y"], s["width"], s["height"])


def intersection_area(a: Box, b: Box) -> Column:
    dx = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    dy = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.greatest(dx, F.lit(0)) * F.greatest(dy, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is not positive."""
    inter = intersection_area(a, b)
    union = a.w * a.h + b.w * b.h - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlaps(a: Box, b: Box) -> Column:
    """Exact prefilter of any positive IoU, in a form a join can test cheaply."""
    return (a.x < b.x + b.w) & (b.x < a.x + a.w) & (a.y < b.y + b.h) & (b.y < a.y + a.h)


def containment(inner: Box, outer: Box) -> Column:
    return intersection_area(inner, outer) / F.greatest(inner.w * inner.h, F.lit(1.0))


def center_inside(inner: Box, outer: Box) -> Column:
    cx, cy = inner.x + inner.w / 2, inner.y + inner.h / 2
    return cx.between(outer.x, outer.x + outer.w) & cy.between(outer.y, outer.y + outer.h)


def contains_point(b: Box, px: Column, py: Column) -> Column:
    return px.between(b.x, b.x + b.w) & py.between(b.y, b.y + b.h)


def expanded(b: Box, pad: float, page_w: Column, page_h: Column) -> Box:
    """Grown by pad on each side and clamped to the page."""
    x, y = F.greatest(b.x - pad, F.lit(0)), F.greatest(b.y - pad, F.lit(0))
    return Box(x, y, F.least(b.w + 2 * pad, page_w - x), F.least(b.h + 2 * pad, page_h - y))


def from_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Box:
    return Box(x0, y0, x1 - x0, y1 - y0)


def from_polygon(points: Column) -> Box:
    """Bounding box of array<struct<x, y>>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return from_corners(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def scaled(b: Box, factor: Column | float) -> Box:
    return Box(*(v * factor for v in b))


def as_struct(b: Box) -> Column:
    return F.struct(b.x.cast("double").alias("x"), b.y.cast("double").alias("y"), b.w.cast("double").alias("width"), b.h.cast("double").alias("height"))


def provider_box(v: Column, is_corners: Column) -> Box:
    """array<double> of four numbers in a stated format -> box with x, y >= 0 and w, h >= 1."""
    n = [F.get(v, i) for i in range(4)]
    w, h = F.when(is_corners, n[2] - n[0]).otherwise(n[2]), F.when(is_corners, n[3] - n[1]).otherwise(n[3])
    return Box(F.greatest(n[0], F.lit(0.0)), F.greatest(n[1], F.lit(0.0)), F.greatest(w, F.lit(1.0)), F.greatest(h, F.lit(1.0)))


def clamp_rect(x1: Column, y1: Column, x2: Column, y2: Column, page_w: Column, page_h: Column) -> Column:
    """Whole-number corners (truncated) inside the page; a rect that lies outside comes out turned over."""
    return F.struct(F.greatest(x1.cast("int"), F.lit(0)).alias("x1"), F.greatest(y1.cast("int"), F.lit(0)).alias("y1"), F.least(x2.cast("int"), page_w.cast("int")).alias("x2"), F.least(y2.cast("int"), page_h.cast("int")).alias("y2"))


def pixel_rect(b: Box, page_w: Column, page_h: Column, pad: Column | int = 0, expand_x: float = 0.0, expand_y: float = 0.0) -> Column:
    """x1, y1, x2, y2 of a box inside the page, wider on each side by pad or by its share, whichever is more."""
    pad = F.lit(pad) if isinstance(pad, int) else pad
    ex, ey = F.greatest(pad, b.w * expand_x), F.greatest(pad, b.h * expand_y)
    return clamp_rect(b.x - ex, b.y - ey, b.x + b.w + ex, b.y + b.h + ey, page_w, page_h)


def padded_rects(rects: Column, page_w: Column, page_h: Column, pad: int = 6) -> Column:
    return F.transform(rects, lambda r: clamp_rect(r["x1"] - pad, r["y1"] - pad, r["x2"] + pad, r["y2"] + pad, page_w, page_h))


def rect_area(r: Column) -> Column:
    return F.greatest(r["x2"] - r["x1"], F.lit(0)) * F.greatest(r["y2"] - r["y1"], F.lit(0))


def erase_rect(b: Box, font_size: Column, page_w: Column, page_h: Column) -> Column:
    return pixel_rect(b, page_w, page_h, F.greatest(F.lit(12), (font_size * 0.8).cast("int")), 0.24, 0.30)


def stored_erase_rect(b: Box, font_size: Column, page_w: Column, page_h: Column) -> Column:
    """Of a box kept with its block: tighter than erase_rect."""
    return pixel_rect(b, page_w, page_h, F.greatest(F.lit(4), (F.coalesce(font_size, F.lit(12)) * 0.4).cast("int")), 0.10, 0.14)


def pdf_rect(b: Box, page_h_px: Column, scale: Column) -> Box:
    """Pixels to PDF points; the y axis turns over."""
    return Box(b.x / scale, (page_h_px - b.y - b.h) / scale, b.w / scale, b.h / scale)


def word_boxes(text: Column, b: Box) -> Column:
    """array<struct<text, x, y, width, height>>: words placed along the line by their weight."""
    w = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    n = F.size(w)
    weights = F.transform(w, lambda t, i: F.length(t) + F.when(i < n - 1, F.lit(0.35)).otherwise(F.lit(0.0)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, v: a + v)
    before = lambda i: F.aggregate(F.slice(weights, F.lit(1), i), F.lit(0.0), lambda a, v: a + v)
    one = lambda t, i: F.struct(t.alias("text"), (b.x + b.w * before(i) / total).alias("x"), b.y.cast("double").alias("y"), (b.w * F.get(weights, i) / total).alias("width"), b.h.cast("double").alias("height"))
    return F.transform(w, one)
