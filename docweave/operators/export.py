"""Semantic HTML export: one string a document, blocks in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..functions.style import css
from ..functions.text import effective_text, html_escape


def html_export(blocks: DataFrame, use_translated: bool = True) -> DataFrame:
    """doc_id, html. blocks: page_number, reading_order, box, font_size, layout_type, alignment,
    direction, font_weight, original_text, translated_text."""
    text = html_escape(effective_text(F.col("original_text"), F.col("translated_text"), use_translated))
    style = css(box(), F.col("font_size"), F.col("font_weight"), F.col("alignment"), F.col("direction"))
    div = F.concat(F.lit('<div class="'), F.col("layout_type"), F.lit('" style="'), style, F.lit('">'), text, F.lit("</div>"))
    pages = blocks.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", div.alias("div")))).alias("of"))
    page = F.concat(F.lit('<section data-page="'), F.col("page_number").cast("string"), F.lit('">'), F.array_join(F.transform("of", lambda x: x["div"]), ""), F.lit("</section>"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", page.alias("page")))).alias("of"))
    return docs.select("doc_id", F.concat(F.lit("<html><body>"), F.array_join(F.transform("of", lambda x: x["page"]), ""), F.lit("</body></html>")).alias("html"))
