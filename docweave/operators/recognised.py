"""Recognised text kept nested (paragraphs, lines, words): flattening, runs, boxes, cache form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import field_box, word_boxes
from .grouping import dedupe_boxes

_BOX = "x:double,y:double,width:double,height:double"
WORD = f"struct<text:string,confidence:double,{_BOX}>"
LINE = f"struct<text:string,confidence:double,{_BOX},words:array<{WORD}>>"
PARAGRAPH = f"struct<text:string,confidence:double,{_BOX},reading_order:int,lines:array<{LINE}>>"
REGION = f"struct<element_type:string,confidence:double,{_BOX},reading_order:int>"
#: Forms in which a page's results are kept in the cache: JSON of these, read back unchanged.
RECOGNISED = f"struct<page_number:int,width:double,height:double,paragraphs:array<{PARAGRAPH}>>"
LAYOUT = f"struct<page_number:int,width:double,height:double,regions:array<{REGION}>>"
_PLACE = ("x", "y", "width", "height")


def _part(s: Column, **more: Column) -> Column:
    return F.struct(s["text"].alias("text"), s["confidence"].alias("confidence"), *(s[c].alias(c) for c in _PLACE), *(v.alias(k) for k, v in more.items()))


def full_lines(paragraph: Column) -> Column:
    """Lines of a paragraph; one without lines but with text is one line of one word."""
    made = F.array(_part(paragraph, words=F.array(_part(paragraph))))
    none = F.coalesce(F.size(paragraph["lines"]), F.lit(0)) <= 0
    return F.when(none & (F.coalesce(paragraph["text"], F.lit("")) != ""), made.cast(f"array<{LINE}>")).when(none, F.array().cast(f"array<{LINE}>")).otherwise(paragraph["lines"])


def flattened(paragraphs: Column) -> Column:
    """struct<paragraphs, lines, words>: paragraphs with full lines, and all lines and words in order."""
    whole = F.transform(paragraphs, lambda p: p.withField("lines", full_lines(p)))
    lines = F.flatten(F.transform(whole, lambda p: p["lines"]))
    return F.struct(whole.alias("paragraphs"), lines.alias("lines"), F.flatten(F.transform(lines, lambda s: F.coalesce(s["words"], F.array().cast(f"array<{WORD}>")))).alias("words"))


def inline_runs(runs: Column, lines: Column, text: Column, place: Column) -> Column:
    """Runs of a block: the ones it has, else one a line, else one of the whole text; no text: none."""
    kind = f"array<struct<text:string,confidence:double,{_BOX}>>"
    of_lines = F.transform(lines, lambda s: _part(s)).cast(kind)
    whole = F.array(F.struct(text.alias("text"), F.lit(1.0).alias("confidence"), *(place[c].alias(c) for c in _PLACE))).cast(kind)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(some(runs), runs.cast(kind)).when(some(lines), of_lines).when(F.coalesce(text, F.lit("")) != "", whole).otherwise(F.array().cast(kind))


def paragraph_boxes(paragraph: Column) -> Column:
    """Boxes to clear for a paragraph: each line's, then its words' (placed by length where the line
    has none); without any the paragraph's own and its words'. Near duplicates go."""
    kind = f"array<struct<{_BOX}>>"
    place = lambda s: F.struct(*(s[c].cast("double").alias(c) for c in _PLACE))
    solid = lambda s: (s["width"] > 0) & (s["height"] > 0)
    none = F.array().cast(kind)
    placed = lambda s: F.when(s["width"] > 0, F.transform(word_boxes(s["text"], field_box(s)), place)).otherwise(none)
    words = lambda s: F.when(F.coalesce(F.size(s["words"]), F.lit(0)) > 0, F.transform(F.filter(s["words"], solid), place)).otherwise(placed(s))
    of_line = lambda s: F.concat(F.when(solid(s), F.array(place(s))).otherwise(none), words(s))
    found = F.flatten(F.transform(F.coalesce(paragraph["lines"], F.array().cast(f"array<{LINE}>")), of_line))
    own = F.when(paragraph["width"] > 0, F.concat(F.array(place(paragraph)), placed(paragraph))).otherwise(none)
    return dedupe_boxes(F.filter(F.when(F.size(found) > 0, found).otherwise(own), solid))


def mean_confidence(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.avg("confidence").alias("mean_confidence"), F.count("*").alias("n"))
