"""Order-dependent grouping on a page, as folds over the page's sorted boxes.

Each fold is a JVM-side aggregate over one array, so pages run in parallel and nothing
is collected. Boxes are structs with x, y, width, height (doubles) and an id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import field_box, iou


def _sorted(boxes: Column, *keys) -> Column:
    """boxes in ascending order of the key functions, by input order on ties."""
    tagged = F.transform(boxes, lambda b, i: F.struct(*(k(b).alias(f"k{n}") for n, k in enumerate(keys)), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(tagged), lambda t: t["b"])


def median_height(boxes: Column) -> Column:
    """Upper median of the positive heights, 16 if there is none."""
    h = F.array_sort(F.filter(F.transform(boxes, lambda b: b["height"].cast("double")), lambda v: v > 0))
    return F.coalesce(F.get(h, F.floor(F.size(h) / 2).cast("int")), F.lit(16.0))


def line_numbers(boxes: Column) -> Column:
    """array<struct<id, line>>: boxes by centre, a line as long as the next centre is within
    max(6, 0.55 * median height) of the line's running centre (c + y) / 2."""
    tolerance = F.greatest(F.lit(6.0), median_height(boxes) * 0.55)
    mid = lambda b: (b["y"] + b["height"] / 2).cast("double")
    none = F.array().cast("array<struct<id:int,line:int>>")
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("c"), none.alias("of"))

    def step(acc: Column, b: Column) -> Column:
        same = (acc["line"] >= 0) & (F.abs(mid(b) - acc["c"]) <= tolerance)
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(line.alias("line"), F.when(same, (acc["c"] + mid(b)) / 2).otherwise(mid(b)).alias("c"), F.concat(acc["of"], F.array(F.struct(b["id"].cast("int").alias("id"), line.alias("line")))).alias("of"))

    return F.aggregate(_sorted(boxes, mid, lambda b: b["x"].cast("double")), start, step, lambda a: a["of"])


def paragraph_numbers(lines: Column, max_lines: int = 10) -> Column:
    """array<struct<id, paragraph>> of lines in order: a break at a gap over 1.35 times the
    larger height, at max_lines lines, or beyond 11 heights from the paragraph's top."""
    none = F.array().cast("array<struct<id:int,paragraph:int>>")
    start = F.struct(F.lit(-1).alias("p"), F.lit(0).alias("n"), F.lit(16.0).alias("h"), F.lit(0.0).alias("bottom"), F.lit(0.0).alias("top"), none.alias("of"))

    def step(acc: Column, b: Column) -> Column:
        y, h = b["y"].cast("double"), b["height"].cast("double")
        tall = F.greatest(acc["h"], h)
        new = (acc["p"] < 0) | (y - acc["bottom"] > tall * 1.35) | (acc["n"] >= max_lines) | (y + h - acc["top"] > tall * max_lines * 1.1)
        p = F.when(new, acc["p"] + 1).otherwise(acc["p"])
        return F.struct(p.alias("p"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), h.alias("h"), (y + h).alias("bottom"), F.when(new, y).otherwise(acc["top"]).alias("top"), F.concat(acc["of"], F.array(F.struct(b["id"].cast("int").alias("id"), p.alias("paragraph")))).alias("of"))

    return F.aggregate(lines, start, step, lambda a: a["of"])


def span_groups(spans: Column) -> Column:
    """array<struct<id, run>>: spans (x0, y0, x1, y1, font_size) that follow each other on a line."""
    none = F.array().cast("array<struct<id:int,run:int>>")
    start = F.struct(F.lit(-1).alias("g"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x1"), F.lit(12.0).alias("fs"), none.alias("of"))

    def step(acc: Column, s: Column) -> Column:
        x0, y0, x1 = (s[c].cast("double") for c in ("x0", "y0", "x1"))
        same = (acc["g"] >= 0) & (F.abs(acc["y0"] - y0) <= acc["fs"] * 0.55) & (x0 - acc["x1"] <= acc["fs"] * 1.8)
        g = F.when(same, acc["g"]).otherwise(acc["g"] + 1)
        fs = F.when(F.coalesce(s["font_size"], F.lit(0)) > 0, s["font_size"].cast("double")).otherwise(F.lit(12.0))
        return F.struct(g.alias("g"), F.when(same, F.least(acc["y0"], y0)).otherwise(y0).alias("y0"), F.when(same, F.greatest(acc["x1"], x1)).otherwise(x1).alias("x1"), F.when(same, acc["fs"]).otherwise(fs).alias("fs"), F.concat(acc["of"], F.array(F.struct(s["id"].cast("int").alias("id"), g.alias("run")))).alias("of"))

    return F.aggregate(_sorted(spans, lambda s: s["y0"].cast("double"), lambda s: s["x0"].cast("double")), start, step, lambda a: a["of"])


def dedupe_boxes(boxes: Column, near: float = 2.0) -> Column:
    """Boxes of positive size without those within near of a kept one in x, y and width; first wins."""
    close = lambda a, b: (F.abs(a["x"] - b["x"]) < near) & (F.abs(a["y"] - b["y"]) < near) & (F.abs(a["width"] - b["width"]) < near)
    real = F.filter(boxes, lambda b: (b["width"] > 0) & (b["height"] > 0))
    return F.aggregate(real, F.slice(real, F.lit(1), F.lit(0)), lambda kept, b: F.when(F.exists(kept, lambda k: close(k, b)), kept).otherwise(F.concat(kept, F.array(b))))


def suppress(boxes: Column, threshold: float = 0.45) -> Column:
    """Greedy non-maximum suppression by falling score (ties: id, y, x)."""
    ranked = _sorted(boxes, lambda b: -b["score"], lambda b: b["id"], lambda b: b["y"], lambda b: b["x"])
    hit = lambda a, b: iou(field_box(a), field_box(b)) >= threshold
    return F.aggregate(ranked, F.slice(ranked, F.lit(1), F.lit(0)), lambda kept, b: F.when(F.exists(kept, lambda k: hit(k, b)), kept).otherwise(F.concat(kept, F.array(b))))


def merge_detections(primary: Column, supplemental: Column, threshold: float = 0.45) -> Column:
    """Boxes (text, score, ...) of two recognisers: where one is empty the other as it is; sparse
    primary text (under 40 characters and less than half) gives way; else supplemental and each
    primary box that overlaps none kept so far; then suppression, in reading order."""
    chars = lambda boxes: F.aggregate(boxes, F.lit(0), lambda a, b: a + F.length(b["text"]))
    hit = lambda a, b: iou(field_box(a), field_box(b)) >= threshold
    grown = F.aggregate(primary, supplemental, lambda kept, b: F.when(F.exists(kept, lambda k: hit(k, b)), kept).otherwise(F.concat(kept, F.array(b))))
    sparse = (chars(primary) < 40) & (chars(supplemental) > 2 * chars(primary))
    merged = suppress(F.when(sparse, supplemental).otherwise(grown), threshold)
    ordered = _sorted(merged, lambda b: b["y"], lambda b: b["x"])
    return F.when(F.size(supplemental) == 0, primary).when(F.size(primary) == 0, supplemental).otherwise(ordered)
