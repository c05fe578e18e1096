"""Named queries over the driver's tables, each with the DuckDB SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import erase as E
from ..functions import geometry as G
from ..functions import prompts as P
from ..functions import style as S
from ..functions import text as T
from ..operators import blocks as B
from ..operators import assembly, display, grouping, quality, recognised, spatial, vision
from ..operators.export import html_export
from ..sources import providers, structure
from ..sources.fixtures import BLOCKS_SQL, HTML_SQL, PAGE_H, PAGE_W, REGIONS_SQL, blocks, html_regions, regions, table
from ..streaming.progress import latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = ["doc_id", "i"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: SQL of shared pieces: capacity, IoU and the style rules on fx_blocks.
CAP = "(greatest(10, trunc(width / (font_size * 0.55))) * greatest(1, trunc(height / (font_size * 1.25))))::INT"
BASE = "greatest(8.0::DOUBLE, least(height * 0.85::DOUBLE, 72.0))"
SIZE = f"CASE WHEN layout_type = 'heading' THEN least({BASE} * 1.35::DOUBLE, 48.0) WHEN layout_type IN ('header', 'footer', 'caption') THEN greatest(8.0::DOUBLE, {BASE} * 0.85::DOUBLE) ELSE {BASE} END"
ALIGN = "CASE WHEN x + width / 2 > 612 * 0.65::DOUBLE THEN 'right' WHEN x + width / 2 < 612 * 0.35::DOUBLE THEN 'left' WHEN layout_type = 'heading' THEN 'center' ELSE 'left' END"
INTER = "(greatest(least(l.x + l.width, r.x + r.width) - greatest(l.x, r.x), 0) * greatest(least(l.y + l.height, r.y + r.height) - greatest(l.y, r.y), 0))"
IOU = f"({INTER} / (l.width * l.height + r.width * r.height - {INTER}))"
PAIR = "l.doc_id = r.doc_id AND l.page_number = r.page_number AND l.x < r.x + r.width AND r.x < l.x + l.width AND l.y < r.y + r.height AND r.y < l.y + l.height"


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).withColumn("max_chars", T.max_chars(F.col("width"), F.col("height"), F.col("font_size")))


@query(f"WITH {BLOCKS_SQL}, b AS (SELECT *, {CAP} AS max_chars FROM fx_blocks), g AS (SELECT doc_id, round(avg(confidence), 3) AS ocr_confidence, round(coalesce(avg(translation_confidence), 1.0), 3) AS translation_qa, sum(CASE WHEN length(translated_text) > max_chars * 1.15::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS overflow_count, count(*) AS blocks_total, sum(CASE WHEN coalesce(translated_text, '') <> '' THEN 1 ELSE 0 END)::BIGINT AS blocks_translated, sum(is_edited::INT)::BIGINT AS blocks_edited FROM b GROUP BY doc_id) SELECT d.doc_id, coalesce(ocr_confidence, 0.0) AS ocr_confidence, coalesce(translation_qa, 0.0) AS translation_qa, coalesce(overflow_count, 0)::BIGINT AS overflow_count, blocks_total, blocks_translated, blocks_edited, CASE WHEN blocks_total IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS source_text_residual, round(greatest(0.0::DOUBLE, 1 - overflow_count * 0.05::DOUBLE), 3) AS layout_quality FROM documents d LEFT JOIN g USING (doc_id)")
def doc_quality_scores(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), _styled(spark, sf_dir))


@query(f"WITH {BLOCKS_SQL}, g AS (SELECT doc_id, sum(CASE WHEN length(translated_text) > {CAP} * 1.15::DOUBLE THEN 1 ELSE 0 END) AS n FROM fx_blocks GROUP BY doc_id) SELECT d.doc_id, concat_ws(',', CASE WHEN n IS NULL THEN 'residual' END, CASE WHEN n > 0 THEN 'overflow' END, CASE WHEN coalesce(round(greatest(0.0::DOUBLE, 1 - n * 0.05::DOUBLE), 3), 0) < 0.7 THEN 'layout' END) AS warnings FROM documents d LEFT JOIN g USING (doc_id)")
def quality_gates(spark, sf_dir):
    return quality.gates(doc_quality_scores(spark, sf_dir)).select("doc_id", F.array_join("warnings", ",").alias("warnings"))


@query(f"WITH {BLOCKS_SQL}, p AS (SELECT doc_id, page_number, sum(CASE WHEN length(translated_text) > {CAP} * 1.15::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS overflow_count FROM fx_blocks GROUP BY ALL) SELECT *, round(greatest(0.0::DOUBLE, 1 - overflow_count * 0.08::DOUBLE), 3) AS layout_score, overflow_count = 0 AS acceptable FROM p")
def verify_pages(spark, sf_dir):
    return quality.verify_pages(_styled(spark, sf_dir))


@query("WITH s AS (SELECT doc_id, left(text, 8000) AS s, text FROM documents), n AS (SELECT doc_id, text, s, len(regexp_extract_all(s, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}]')) AS ar, len(regexp_extract_all(s, '[\\x{0400}-\\x{04FF}]')) AS ru, len(regexp_extract_all(s, '[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]')) AS zh, len(regexp_extract_all(s, '[A-Za-z]')) AS en FROM s) SELECT doc_id, CASE WHEN trim(text) = '' OR greatest(ar, ru, zh, en) < 8 THEN 'en' WHEN ar = greatest(ar, ru, zh, en) THEN 'ar' WHEN ru = greatest(ar, ru, zh, en) THEN 'ru' WHEN zh = greatest(ar, ru, zh, en) THEN 'zh' ELSE 'en' END AS language FROM n")
def language_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, page_number, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y, x, i) - 1)::INT AS reading_order FROM fx_blocks")
def reading_order(spark, sf_dir):
    return B.reading_order(blocks(spark, sf_dir), "i").select("doc_id", "i", "page_number", "reading_order")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, round(({SIZE})::DECIMAL(20,15), 1)::DOUBLE AS font_size, round((({SIZE}) * 1.2::DOUBLE)::DECIMAL(20,15), 1)::DOUBLE AS line_height, CASE WHEN layout_type = 'heading' THEN 'bold' ELSE 'normal' END AS font_weight, {ALIGN} AS alignment, 'ltr' AS direction FROM fx_blocks")
def infer_style(spark, sf_dir):
    st = S.infer_style(G.box(), F.col("layout_type"), F.lit(PAGE_W), F.col("lang"))
    return blocks(spark, sf_dir).select("doc_id", "i", *(c.alias(n) for n, c in st.items()))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, {CAP} AS max_chars FROM fx_blocks")
def max_chars(spark, sf_dir):
    return _styled(spark, sf_dir).select("doc_id", "i", "max_chars")


@query(f"WITH {BLOCKS_SQL}, b AS (SELECT *, {CAP} AS m FROM fx_blocks) SELECT doc_id, i, CASE WHEN length(translated_text) > m AND layout_type IN ('heading', 'header', 'footer', 'caption') THEN rtrim(left(translated_text, m - 1)) || '…' WHEN length(translated_text) > m THEN left(translated_text, m) ELSE translated_text END AS translated_text FROM b")
def enforce_length(spark, sf_dir):
    b = _styled(spark, sf_dir)
    return b.select("doc_id", "i", T.enforce_length(F.col("translated_text"), F.col("max_chars"), F.col("layout_type")).alias("translated_text"))


_LINES = lambda t: f"greatest(greatest(1, trunc(greatest(1, length({t})) / greatest(8.0::DOUBLE, width / greatest(4.0::DOUBLE, font_size * 0.52::DOUBLE)))), greatest(1, trunc(greatest(1, len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''))) / greatest(1.0::DOUBLE, greatest(8.0::DOUBLE, width / greatest(4.0::DOUBLE, font_size * 0.52::DOUBLE)) / 6)))::INT // 2)"
_HEIGHT = f"least(greatest(height, least(height * least(greatest(greatest({_LINES('t')} / {_LINES('original_text')}, length(t) / greatest(length(original_text), 1) * 0.85::DOUBLE), 1.0), 2.8::DOUBLE), {_LINES('t')} * lh + 6)), greatest(height, 792 - y - 4))"


@query(f"WITH {BLOCKS_SQL}, b AS (SELECT *, coalesce(nullif(translated_text, ''), original_text) AS t, font_size * 1.2::DOUBLE AS lh FROM fx_blocks) SELECT doc_id, i, round({_HEIGHT}, 6) AS height FROM b")
def compose_bbox(spark, sf_dir):
    text = T.effective_text(F.col("original_text"), F.col("translated_text"))
    h = S.composed_height(G.box(), F.col("original_text"), text, F.col("font_size"), F.col("font_size") * 1.2, F.lit(PAGE_H))
    return blocks(spark, sf_dir).select("doc_id", "i", F.round(h, 6).alias("height"))


@query(f"WITH {BLOCKS_SQL}, b AS (SELECT *, {CAP} AS m FROM fx_blocks) SELECT doc_id, i, CASE WHEN length(translated_text) > m * 1.1::DOUBLE THEN greatest(8.0::DOUBLE, round(font_size * least(1.0::DOUBLE, m / length(translated_text)), 1)) ELSE font_size::DOUBLE END AS font_size FROM b")
def layout_solve(spark, sf_dir):
    b = _styled(spark, sf_dir)
    return b.select("doc_id", "i", S.solved_font_size(F.col("font_size"), F.coalesce(F.length("translated_text"), F.lit(0)), F.col("max_chars")).alias("font_size"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, CASE {ALIGN} WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' ELSE {ALIGN} END AS alignment, 'rtl' AS direction, 'arabic' AS script FROM fx_blocks")
def rtl_typography(spark, sf_dir):
    st, target = S.infer_style(G.box(), F.col("layout_type"), F.lit(PAGE_W), F.col("lang")), F.lit("ar")
    return blocks(spark, sf_dir).select("doc_id", "i", S.rtl_alignment(st["alignment"], target).alias("alignment"), F.when(T.is_rtl_language(target), "rtl").otherwise("ltr").alias("direction"), S.target_script(target).alias("script"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, page_number FROM fx_blocks WHERE NOT is_edited AND page_number IN (1, 2)")
def translation_filter(spark, sf_dir):
    return B.translation_targets(blocks(spark, sf_dir), pages=[1, 2]).select("doc_id", "i", "page_number")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, count(*) AS total, sum((trim(coalesce(translated_text, '')) <> '')::INT)::BIGINT AS translated, sum(coalesce(trim(translated_text) <> '' AND trim(translated_text) = trim(original_text), false)::INT)::BIGINT AS unchanged FROM fx_blocks GROUP BY doc_id")
def translation_stats(spark, sf_dir):
    return B.translation_stats(blocks(spark, sf_dir), ["doc_id"])


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, lag(left(original_text, 120)) OVER w AS prev_text, lead(left(original_text, 120)) OVER w AS next_text FROM fx_blocks WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, i)")
def context_prev_next(spark, sf_dir):
    return B.with_context(blocks(spark, sf_dir), "original_text", ["doc_id"], ["page_number", "i"]).select("doc_id", "i", "prev_text", "next_text")


@query("SELECT conv_id, turn, lag(left(text, 120)) OVER w AS prev_text, lead(left(text, 120)) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_context(spark, sf_dir):
    return B.with_context(table(spark, sf_dir, "conversations"), "text", ["conv_id"], ["turn"]).select("conv_id", "turn", "prev_text", "next_text")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, ((row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y, x, i) - 1) // 10)::INT AS batch FROM fx_blocks")
def batches(spark, sf_dir):
    return B.batches(blocks(spark, sf_dir), ["y", "x", "i"]).select("doc_id", "i", "batch")


_NEEDS = "(coalesce(translation_confidence < 0.7, false) OR coalesce(translated_text, '') = '')"


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, {_NEEDS} AS needs_review, is_edited AS edited, coalesce(trim(translated_text) = trim(original_text), false) AND lang <> 'ar' AS unchanged, is_edited OR coalesce(translation_confidence, 1) >= 0.7 AS reviewed, coalesce(translation_confidence < 0.7, false) AS highlight, translated_text IS NOT NULL AND trim(translated_text) <> trim(original_text) AS text_differs, coalesce(length(translated_text) > {CAP} * 1.15::DOUBLE, false) AS overflow FROM fx_blocks")
def review_flags(spark, sf_dir):
    b = B.review_flags(_styled(spark, sf_dir), F.col("lang"), F.lit("ar")).withColumn("overflow", quality.overflows(F.col("translated_text"), F.col("max_chars")))
    return b.select("doc_id", "i", "needs_review", "edited", "unchanged", "reviewed", "highlight", "text_differs", "overflow")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, sum({_NEEDS}::INT)::BIGINT AS needs_review, sum((is_edited OR coalesce(translation_confidence, 1) >= 0.7)::INT)::BIGINT AS reviewed, sum((translated_text IS NULL)::INT)::BIGINT AS untranslated, count(*) AS total FROM fx_blocks GROUP BY doc_id")
def review_counts(spark, sf_dir):
    b = B.review_flags(blocks(spark, sf_dir), F.col("lang"), F.lit("ar"))
    n = lambda c: F.sum(c.cast("int"))
    return b.groupBy("doc_id").agg(n(F.col("needs_review")).alias("needs_review"), n(F.col("reviewed")).alias("reviewed"), n(F.col("translated_text").isNull()).alias("untranslated"), F.count("*").alias("total"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i FROM fx_blocks WHERE contains(lower(original_text), 'license')")
def search_hits(spark, sf_dir):
    return blocks(spark, sf_dir).where(F.contains(F.lower("original_text"), F.lit("license"))).select("doc_id", "i")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(\{[^}]+\}|\[\[[^\]]+\]\]|[$€£¥]\s?[\d,.]+|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\b\d{4}\b|@[\w.-]+\.\w+)', 1))::INT AS n_kept, array_to_string(regexp_extract_all(text, '(\{[^}]+\}|\[\[[^\]]+\]\]|[$€£¥]\s?[\d,.]+|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\b\d{4}\b|@[\w.-]+\.\w+)', 1), '|') AS kept, true AS restored FROM documents")
def protect_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", "text", T.protect(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p.kept").alias("n_kept"), F.array_join("p.kept", "|").alias("kept"), (T.unprotect(F.col("p.text"), F.col("p.kept")) == F.col("text")).alias("restored"))


@query(f"WITH {BLOCKS_SQL}, w AS (SELECT doc_id, i, x, width, list_filter(regexp_split_to_array(original_text, '\\s+'), lambda t: t <> '') AS ws FROM fx_blocks), e AS (SELECT doc_id, i, x, width, unnest(ws) AS word, unnest(range(len(ws))) AS k, len(ws) AS n FROM w), g AS (SELECT *, length(word) * 100 + CASE WHEN k < n - 1 THEN 35 ELSE 0 END AS wt FROM e) SELECT doc_id, i, k::INT AS k, word, round(x + width * coalesce(sum(wt) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(wt) OVER (PARTITION BY doc_id, i), 6) AS x, round(width * wt / sum(wt) OVER (PARTITION BY doc_id, i), 6) AS w FROM g")
def word_boxes(spark, sf_dir):
    return assembly.word_places(blocks(spark, sf_dir), KEYS, "original_text")


@query("SELECT doc_id, source, n_chars, (len(string_split(text, chr(10))))::INT AS n_lines, substring(sha256(text), 1, 16) AS content_hash FROM documents")
def doc_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.size(F.split("text", "\n")).alias("n_lines"), T.file_hash(F.col("text")).alias("content_hash"))


@query(f"WITH {BLOCKS_SQL}, p AS (SELECT doc_id, page_number, count(*) AS n, sum(length(original_text)) AS c FROM fx_blocks GROUP BY ALL) SELECT doc_id, count(*) AS pages, sum((n >= 3 AND c >= 40)::INT)::BIGINT AS good_pages, sum((n >= 3 AND c >= 40)::INT) >= greatest(1, count(*) // 2) AS born_digital FROM p GROUP BY doc_id")
def born_digital(spark, sf_dir):
    return B.born_digital(blocks(spark, sf_dir), text="original_text")


_PX = lambda n, v: f"'{n}:' || round(({v})::DOUBLE, 1)::VARCHAR || 'px'"
_ESC = "replace(replace(replace(replace(replace(coalesce(nullif(translated_text, ''), original_text), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"WITH {BLOCKS_SQL}, d AS (SELECT doc_id, page_number, i, '<div class=\"' || layout_type || '\" style=\"' || concat_ws(';', 'position:absolute', {_PX('left', 'x')}, {_PX('top', 'y')}, {_PX('width', 'width')}, {_PX('min-height', 'height')}, {_PX('font-size', 'font_size')}, CASE WHEN layout_type = 'heading' THEN 'font-weight:bold' END, 'text-align:' || {ALIGN}) || '\">' || {_ESC} || '</div>' AS div, y, x FROM fx_blocks), p AS (SELECT doc_id, page_number, '<section data-page=\"' || page_number || '\">' || string_agg(div, '' ORDER BY y, x, i) || '</section>' AS page FROM d GROUP BY doc_id, page_number) SELECT doc_id, sha256('<html><body>' || string_agg(page, '' ORDER BY page_number) || '</body></html>') AS html_hash FROM p GROUP BY doc_id")
def html_export_hash(spark, sf_dir):
    st = S.infer_style(G.box(), F.col("layout_type"), F.lit(PAGE_W), F.col("lang"))
    b = B.reading_order(blocks(spark, sf_dir), "i").withColumns({k: st[k] for k in ("alignment", "direction", "font_weight")})
    return html_export(b).select("doc_id", F.sha2("html", 256).alias("html_hash"))


@query(f"WITH {REGIONS_SQL} SELECT l.doc_id, l.page_number, l.i, r.rid, round({IOU}, 9) AS iou FROM fx_blocks l JOIN fx_regions r ON {PAIR}")
def iou_pairs(spark, sf_dir):
    p = spatial.overlap_pairs(blocks(spark, sf_dir), regions(spark, sf_dir))
    return p.select("l.doc_id", "l.page_number", "l.i", "r.rid", F.round("iou", 9).alias("iou"))


@query(f"WITH {REGIONS_SQL}, p AS (SELECT l.doc_id, l.i, r.rid, r.element_type, row_number() OVER (PARTITION BY l.doc_id, l.page_number, l.i ORDER BY {IOU} DESC, r.rid) AS k FROM fx_blocks l JOIN fx_regions r ON {PAIR} AND {IOU} >= 0.15) SELECT b.doc_id, b.i, p.rid, CASE WHEN element_type IN ('heading', 'title') THEN 'heading' WHEN element_type IN ('list', 'caption', 'quote', 'header', 'footer', 'sidebar') THEN element_type ELSE 'paragraph' END AS layout_type FROM fx_blocks b LEFT JOIN p ON p.doc_id = b.doc_id AND p.i = b.i AND k = 1")
def region_match(spark, sf_dir):
    m = spatial.match_region(blocks(spark, sf_dir), regions(spark, sf_dir), "i")
    return m.select("doc_id", "i", "rid", S.lookup(F.coalesce("element_type", F.lit("")), S.TEXT_TYPE, "paragraph").alias("layout_type"))


@query(f"WITH {REGIONS_SQL} SELECT l.doc_id, l.i, min(r.rid) AS rid FROM fx_blocks l LEFT JOIN fx_regions r ON {PAIR} AND {IOU} > 0.3 GROUP BY l.doc_id, l.i")
def first_match(spark, sf_dir):
    return spatial.first_match(blocks(spark, sf_dir), regions(spark, sf_dir), "i", "rid", 0.3, strict=True).select("doc_id", "i", "rid")


_CENTER = "(r.x + r.width / 2) BETWEEN l.x AND l.x + l.width AND (r.y + r.height / 2) BETWEEN l.y AND l.y + l.height"


@query(f"WITH {REGIONS_SQL}, s AS (SELECT l.doc_id, l.page_number, l.rid, l.x AS rx, l.y AS ry, r.i, greatest({IOU}, CASE WHEN {_CENTER} THEN 0.35 ELSE 0 END) AS score, {IOU} AS u FROM fx_regions l JOIN fx_blocks r ON {PAIR}), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, rid ORDER BY score DESC, i) AS k FROM s WHERE score >= 0.35), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY ry, rx, rid) AS f FROM t WHERE k = 1) SELECT doc_id, i, rid FROM a WHERE f = 1 UNION ALL SELECT b.doc_id, b.i, NULL FROM fx_blocks b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = b.doc_id AND s.i = b.i AND u >= 0.35) AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.i = b.i AND f = 1)")
def region_assign(spark, sf_dir):
    return spatial.assign_regions(regions(spark, sf_dir), blocks(spark, sf_dir), "i").select("doc_id", "i", "rid")


_RATIO = "(greatest(width * height, 1) / (612 * 792))"


@query(f"WITH {REGIONS_SQL}, n AS (SELECT l.doc_id, l.page_number, l.rid, l.width, l.height, count(r.i) AS n_inside, coalesce(sum(length(r.original_text)), 0)::BIGINT AS chars_inside FROM fx_regions l LEFT JOIN fx_blocks r ON {PAIR} AND {INTER} / greatest(r.width * r.height, 1) >= 0.45 WHERE l.element_type = 'figure' GROUP BY ALL) SELECT doc_id, page_number, rid, n_inside, chars_inside, {_RATIO} < 0.06 OR n_inside = 0 OR NOT CASE WHEN {_RATIO} >= 0.30 THEN n_inside >= 2 OR chars_inside >= 60 ELSE n_inside >= 4 OR chars_inside >= 120 END AS emit FROM n")
def image_emit(spark, sf_dir):
    out = spatial.emit_images(regions(spark, sf_dir).where("element_type = 'figure'"), blocks(spark, sf_dir), PAGE_W * PAGE_H)
    return out.select("doc_id", "page_number", "rid", "n_inside", "chars_inside", "emit")


@query(f"WITH {REGIONS_SQL} SELECT l.doc_id, l.i FROM fx_blocks l WHERE NOT EXISTS (SELECT 1 FROM fx_regions r WHERE r.element_type = 'list' AND {PAIR} AND {IOU} >= 0.65)")
def image_filter(spark, sf_dir):
    return spatial.not_covered(blocks(spark, sf_dir), regions(spark, sf_dir).where("element_type = 'list'"), 0.65).select("doc_id", "i")


@query(f"WITH {REGIONS_SQL} SELECT l.doc_id, l.i FROM fx_blocks l WHERE NOT EXISTS (SELECT 1 FROM fx_regions r WHERE r.element_type = 'quote' AND {PAIR} AND {IOU} >= 0.45)")
def span_cover(spark, sf_dir):
    return spatial.not_covered(blocks(spark, sf_dir), regions(spark, sf_dir).where("element_type = 'quote'"), 0.45).select("doc_id", "i")


@query(f"WITH {REGIONS_SQL}, t AS (SELECT l.doc_id, l.page_number, l.rid, list(r.original_text ORDER BY r.i) FILTER (r.i IS NOT NULL) AS rows FROM fx_regions l LEFT JOIN fx_blocks r ON {PAIR} AND {IOU} >= 0.15 WHERE l.element_type = 'table' GROUP BY ALL) SELECT doc_id, page_number, rid, coalesce(array_to_string(rows, '|'), ' ') AS rows FROM t")
def table_fallback(spark, sf_dir):
    t = spatial.table_rows(regions(spark, sf_dir).where("element_type = 'table'"), blocks(spark, sf_dir), "i")
    return t.select("doc_id", "page_number", "rid", F.array_join("rows", "|").alias("rows"))


@query(f"WITH {REGIONS_SQL}, u AS (SELECT doc_id, page_number, i AS id, 'text' AS type, x, y, 0 AS e FROM fx_blocks UNION ALL SELECT doc_id, page_number, rid, 'table', x, y, 1 FROM fx_regions WHERE element_type = 'table' UNION ALL SELECT doc_id, page_number, rid, 'image', x, y, 2 FROM fx_regions WHERE element_type = 'figure') SELECT doc_id, page_number, id, type, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y, x, e, id) - 1)::INT AS reading_order FROM u")
def merge_page(spark, sf_dir):
    r = regions(spark, sf_dir)
    part = lambda df, key, kind, e: df.select("doc_id", "page_number", F.col(key).alias("id"), F.lit(kind).alias("type"), "x", "y", F.lit(e).alias("emit_seq"))
    u = part(blocks(spark, sf_dir), "i", "text", 0).unionByName(part(r.where("element_type = 'table'"), "rid", "table", 1)).unionByName(part(r.where("element_type = 'figure'"), "rid", "image", 2))
    return B.reading_order(u, "emit_seq", "id").select("doc_id", "page_number", "id", "type", "reading_order")


@query()
def line_groups(spark, sf_dir):
    b = spatial.page_boxes(blocks(spark, sf_dir).withColumnRenamed("i", "id"), "id", "x", "y", "width", "height")
    return b.select("doc_id", "page_number", F.explode(grouping.line_numbers(F.array_sort("boxes"))).alias("r")).select("doc_id", "page_number", F.col("r.id").alias("i"), "r.line")


@query()
def paragraph_groups(spark, sf_dir):
    fields = [F.col("y").cast("double").alias("y"), "id", F.col("height").cast("double").alias("height")]
    b = blocks(spark, sf_dir).withColumnRenamed("i", "id").groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("boxes"))
    return b.select("doc_id", "page_number", F.explode(grouping.paragraph_numbers(F.col("boxes"))).alias("r")).select("doc_id", "page_number", F.col("r.id").alias("i"), "r.paragraph")


@query()
def span_merge(spark, sf_dir):
    s = blocks(spark, sf_dir).select("doc_id", "page_number", F.col("i").alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"), "font_size")
    g = s.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("id", "x0", "y0", "x1", "y1", "font_size"))).alias("spans"))
    return g.select("doc_id", "page_number", F.explode(grouping.span_groups(F.col("spans"))).alias("r")).select("doc_id", "page_number", F.col("r.id").alias("i"), "r.run")


def _scored(df: DataFrame, key: str = "i", dx: int = 0, dy: int = 0) -> DataFrame:
    n = F.size(T.tokens(F.col("original_text")))
    score = F.length("original_text") + 12.0 + n * 4 + F.col("confidence") * 10
    cols = [F.col(key).cast("int").alias("id"), F.round(score, 6).alias("score"), F.col("original_text").alias("text"), (F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")]
    return df.select("doc_id", "page_number", *cols)


_BOX = ("id", "score", "text", "x", "y", "width", "height")


@query()
def ocr_nms(spark, sf_dir):
    b = blocks(spark, sf_dir)
    both = _scored(b).unionByName(_scored(b.where("i % 3 <> 0").withColumn("i", F.col("i") + 100000), "i", 3, 2))
    g = spatial.page_boxes(both, *_BOX)
    return g.select("doc_id", "page_number", F.explode(grouping.suppress(F.array_sort("boxes"))).alias("r")).select("doc_id", "page_number", "r.id", "r.score")


@query()
def ocr_merge(spark, sf_dir):
    b = blocks(spark, sf_dir)
    p = spatial.page_boxes(_scored(b.where("i % 2 = 0")), *_BOX).withColumnRenamed("boxes", "p")
    s = spatial.page_boxes(_scored(b.where("i % 3 <> 0").withColumn("i", F.col("i") + 100000), "i", 3, 2), *_BOX).withColumnRenamed("boxes", "s")
    both = p.join(s, ["doc_id", "page_number"], "full")
    none = F.filter(F.coalesce("p", "s"), lambda x: F.lit(False))
    merged = grouping.merge_detections(F.array_sort(F.coalesce("p", none)), F.array_sort(F.coalesce("s", none)))
    return both.select("doc_id", "page_number", F.explode(merged).alias("r")).select("doc_id", "page_number", "r.id")


@query(f"WITH {HTML_SQL} SELECT * FROM fx_html")
def html_blocks(spark, sf_dir):
    return html_regions(spark, sf_dir)


@query(f"WITH {HTML_SQL}, s AS (SELECT *, sum((element_type IN ('title', 'heading') OR k0)::INT) OVER (PARTITION BY page_id ORDER BY y, x, k) - 1 AS section FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, k) = 1 AS k0 FROM fx_html)), h AS (SELECT *, first_value(element_type IN ('title', 'heading')) OVER (PARTITION BY page_id, section ORDER BY y, x, k) AS headed FROM s) SELECT page_id, k, section::BIGINT AS section, CASE WHEN headed THEN 'heading' ELSE 'paragraph' END AS section_kind, headed::INT AS level FROM h")
def sections(spark, sf_dir):
    return vision.sections(html_regions(spark, sf_dir), ["page_id"], "k").select("page_id", "k", "section", "section_kind", "level")


@query(f"WITH {BLOCKS_SQL}, c AS (SELECT *, CASE WHEN sum((x + width / 2 < 306 * 0.9::DOUBLE)::INT) OVER w >= 3 AND sum((x + width / 2 > 306 * 1.1::DOUBLE)::INT) OVER w >= 3 THEN 2 ELSE 1 END AS column_count FROM fx_blocks WINDOW w AS (PARTITION BY doc_id, page_number)) SELECT doc_id, i, column_count, CASE WHEN column_count > 1 AND x + width / 2 > 306 THEN 1 ELSE 0 END AS column_index FROM c")
def columns(spark, sf_dir):
    return vision.columns(blocks(spark, sf_dir), ["doc_id", "page_number"], PAGE_W).select("doc_id", "i", "column_count", "column_index")


@query(f"WITH {HTML_SQL}, p AS (SELECT l.page_id, l.k AS header, r.k AS body, row_number() OVER (PARTITION BY l.page_id, l.k ORDER BY r.y, r.x, r.k) AS rank FROM fx_html l JOIN fx_html r ON l.page_id = r.page_id AND r.y > l.y AND l.element_type = 'header' AND r.element_type NOT IN ('header', 'footer', 'logo')) SELECT page_id, header, body, rank::INT AS rank FROM p WHERE rank <= 3")
def header_links(spark, sf_dir):
    return vision.header_links(html_regions(spark, sf_dir), ["page_id"], "k")


@query(f"WITH {BLOCKS_SQL}, c AS (SELECT doc_id, page_number, i, x, y, width, height, CASE WHEN i % 3 = 1 THEN 'caption' WHEN i % 3 = 2 THEN 'figure' ELSE 'paragraph' END AS element_type FROM fx_blocks), p AS (SELECT l.doc_id, l.page_number, l.i AS caption, r.i AS figure, (abs(l.y - (r.y + r.height)) + abs(l.x - r.x))::DOUBLE AS distance, {INTER} / (l.width * l.height + r.width * r.height - {INTER}) AS u, r.x AS fx, r.y AS fy FROM c l JOIN c r ON l.doc_id = r.doc_id AND l.page_number = r.page_number AND l.element_type = 'caption' AND r.element_type = 'figure'), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, caption ORDER BY distance, fy, fx, figure) AS k FROM p WHERE distance < 200 AND u < 0.3) SELECT doc_id, page_number, caption, figure, distance FROM k WHERE k = 1")
def caption_links(spark, sf_dir):
    kind = F.when(F.col("i") % 3 == 1, "caption").when(F.col("i") % 3 == 2, "figure").otherwise("paragraph")
    return vision.caption_links(blocks(spark, sf_dir).withColumn("element_type", kind), ["doc_id", "page_number"], "i")


@query(f"WITH {HTML_SQL} SELECT page_id, k, CASE element_type WHEN 'title' THEN 1.0 WHEN 'paragraph' THEN 0.5 WHEN 'list' THEN 0.55 WHEN 'header' THEN 0.35 ELSE 0.3 END::DOUBLE AS importance, CASE element_type WHEN 'title' THEN 1 WHEN 'header' THEN 0 WHEN 'footer' THEN 0 ELSE 3 END AS hierarchy_level, 'center' AS alignment, CASE element_type WHEN 'title' THEN 15.0 WHEN 'header' THEN 13.0 WHEN 'footer' THEN 13.0 ELSE 17.0 END::DOUBLE AS estimated_font_size, element_type IN ('header', 'footer') AS is_decorative FROM fx_html")
def region_attributes(spark, sf_dir):
    return vision.attributes(html_regions(spark, sf_dir), PAGE_W).select("page_id", "k", "importance", "hierarchy_level", "alignment", "estimated_font_size", "is_decorative")


@query("SELECT source, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 0.9 ELSE 0.5 END), 6) AS confidence FROM labels JOIN documents USING (doc_id) GROUP BY source")
def qa_confidence(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("quality") == 1, 0.9).otherwise(0.5)), 6).alias("confidence"))


@query("WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS a, list_filter(regexp_split_to_array(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), '\\s+'), lambda w: w <> '') AS b FROM conversations) SELECT conv_id, turn, round(least(0.9::DOUBLE, len(list_distinct(list_intersect(a, b))) / greatest(len(a), 1)), 6) AS overlap FROM t WHERE b IS NOT NULL")
def token_overlap_qa(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    return c.select("conv_id", "turn", F.round(T.token_overlap(F.col("text"), F.col("next")), 6).alias("overlap"))


@query("WITH e AS (SELECT user_id AS document_id, event_type AS stage, event_id AS elapsed_ms, value, max(value) OVER () AS m FROM events) SELECT document_id, arg_max(stage, elapsed_ms) AS stage, max(elapsed_ms) AS elapsed_ms, round(arg_max(value / m, elapsed_ms), 6) AS progress, count(*) AS events FROM e GROUP BY document_id")
def progress_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("value").alias("m"))
    ev = e.join(F.broadcast(top)).select(F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("elapsed_ms"), (F.col("value") / F.col("m")).alias("progress"))
    return latest(ev).withColumn("progress", F.round("progress", 6))


@query("SELECT user_id, event_type, count(*) AS runs, round(sum(value), 3) AS total_ms FROM events GROUP BY ALL")
def stage_timings(spark, sf_dir):
    return quality.stage_timings(table(spark, sf_dir, "events"), "user_id", "event_type", "value")


@query(f"WITH {BLOCKS_SQL}, c AS (SELECT doc_id, i, substring(sha256(original_text), 1, 16) AS hash FROM fx_blocks), h AS (SELECT DISTINCT hash FROM c WHERE i % 2 = 0) SELECT doc_id, i, h.hash IS NOT NULL AS cache_hit FROM c LEFT JOIN h USING (hash)")
def cache_probe(spark, sf_dir):
    c = blocks(spark, sf_dir).select("doc_id", "i", T.file_hash(F.col("original_text")).alias("hash"))
    known = c.where("i % 2 = 0").select("hash", F.lit("cached").alias("value"))
    return B.cache_probe(c, known, ["hash"], "value", F.lit("computed")).select("doc_id", "i", "cache_hit")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, CASE WHEN i % 6 = 0 THEN 'new' ELSE translated_text END AS translated_text, i % 6 = 0 OR is_edited AS is_edited FROM fx_blocks")
def block_updates(spark, sf_dir):
    b = blocks(spark, sf_dir)
    u = b.where("i % 6 = 0").select("doc_id", "i", F.explode(F.array(F.struct(F.lit(1).alias("v"), F.lit("old").alias("translated_text")), F.struct(F.lit(2).alias("v"), F.lit("new").alias("translated_text")))).alias("u")).select("doc_id", "i", "u.*")
    return B.apply_updates(b, u, KEYS, ["translated_text"], "v").select("doc_id", "i", "translated_text", "is_edited")


_ERASE = "greatest(12, trunc(font_size * 0.8::DOUBLE))"


@query(f"WITH {BLOCKS_SQL}, e AS (SELECT *, greatest({_ERASE}, width * 0.24::DOUBLE) AS ex, greatest({_ERASE}, height * 0.30::DOUBLE) AS ey FROM fx_blocks) SELECT doc_id, i, greatest(trunc(x - ex), 0)::INT AS x1, greatest(trunc(y - ey), 0)::INT AS y1, least(trunc(x + width + ex), 612)::INT AS x2, least(trunc(y + height + ey), 792)::INT AS y2 FROM e")
def erase_rects(spark, sf_dir):
    r = G.erase_rect(G.box(), F.col("font_size"), F.lit(PAGE_W), F.lit(PAGE_H))
    return blocks(spark, sf_dir).select("doc_id", "i", r.alias("r")).select("doc_id", "i", "r.*")


@query()
def glossary_wrap(spark, sf_dir):
    """Terms are the longer words of the benchmark's items: a small list whose size is checked."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.lower("text"))).alias("term")).where(F.length("term") >= 10).groupBy("term").count().select("term")  # all of them
    terms = words.agg(F.collect_list(F.struct("term", F.upper("term").alias("translation"))).alias("terms"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")).join(F.broadcast(terms))
    w = docs.select("doc_id", "text", T.wrap_terms(F.col("text"), F.col("terms")).alias("w"))
    return w.select("doc_id", F.size("w.used").alias("n_terms"), T.unwrap_terms(F.col("w.text"), F.col("w.used")).alias("text"))


_BUILT = "fx_built AS (SELECT doc_id, page_number, y AS line, string_agg(trim(original_text), ' ' ORDER BY x, i) AS text, avg(confidence) AS confidence, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM fx_blocks GROUP BY doc_id, page_number, line)"


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).withColumn("line", F.col("y"))
    return assembly.build_lines(b, ["doc_id", "page_number", "line"], ["x", "i"], "original_text")


@query(f"WITH {BLOCKS_SQL}, {_BUILT} SELECT doc_id, page_number, line, text, round(confidence, 6) AS confidence, x, y, width, height FROM fx_built")
def line_build(spark, sf_dir):
    return _built(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {BLOCKS_SQL}, {_BUILT}, p AS (SELECT doc_id, page_number, string_agg(text, ' ' ORDER BY line) AS text, avg(confidence) AS c, count(*) AS n_lines, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM fx_built GROUP BY doc_id, page_number) SELECT doc_id, page_number, text, round(c, 6) AS confidence, n_lines, x, y, width, height, round(length(text) + 12 * n_lines + 4 * len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) + 10 * c, 4) AS score FROM p")
def paragraph_build(spark, sf_dir):
    p = assembly.build_paragraphs(_built(spark, sf_dir), ["doc_id", "page_number"], ["line"])
    p = p.withColumn("score", F.round(assembly.paragraph_score(F.col("text"), F.col("n_lines"), F.col("confidence")), 4))
    return p.withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page_number, count(y) AS n, count(DISTINCT y) AS n_distinct FROM fx_blocks GROUP BY ALL HAVING count(y) <> count(DISTINCT y)")
def duplicate_orders(spark, sf_dir):
    return assembly.duplicate_orders(blocks(spark, sf_dir), ["doc_id", "page_number"], "y")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, k::INT AS k, CASE k WHEN 0 THEN 0 WHEN 1 THEN width WHEN 2 THEN width + height ELSE width + height + font_size END::DOUBLE AS offset_px FROM fx_blocks, range(4) r(k)")
def cell_offsets(spark, sf_dir):
    sizes = F.array(*(F.col(c).cast("double") for c in ("width", "height", "font_size")))
    return blocks(spark, sf_dir).select("doc_id", "i", F.posexplode(assembly.running_offsets(sizes)).alias("k", "offset_px"))


@query(ORACLES["erase_rects"].replace(_ERASE, "greatest(4, trunc(font_size * 0.4::DOUBLE))").replace("0.24::DOUBLE", "0.10::DOUBLE").replace("0.30::DOUBLE", "0.14::DOUBLE"))
def stored_erase_rects(spark, sf_dir):
    r = G.stored_erase_rect(G.box(), F.col("font_size"), F.lit(PAGE_W), F.lit(PAGE_H))
    return blocks(spark, sf_dir).select("doc_id", "i", r.alias("r")).select("doc_id", "i", "r.*")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, round(coalesce(translation_confidence, confidence) * 100)::INT || '%' AS shown, coalesce(round(translation_confidence * 100)::INT || '%', '0%') AS qa, x * 1.5::DOUBLE AS x, y * 1.5::DOUBLE AS y, width * 1.5::DOUBLE AS width, height * 1.5::DOUBLE AS height, font_size * 1.5::DOUBLE AS font_size FROM fx_blocks")
def shown_blocks(spark, sf_dir):
    own = display.on_screen(G.box(), F.col("font_size"), 1.5)
    return blocks(spark, sf_dir).select("doc_id", "i", display.shown_confidence(F.col("translation_confidence"), F.col("confidence")).alias("shown"), display.percent(F.col("translation_confidence")).alias("qa"), *(c.cast("double").alias(n) for n, c in own.items()))


@query("WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '(?i)failed|error|timeout|not installed|unavailable')))::INT AS n_failures, len(list_filter(w, lambda x: NOT regexp_matches(x, '(?i)failed|error|timeout|not installed|unavailable')))::INT AS n_others FROM w")
def warning_kinds(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("w"))
    return w.select("doc_id", F.size(display.failures(F.col("w"))).alias("n_failures"), F.size(display.other_warnings(F.col("w"))).alias("n_others"))


@query(f"WITH {BLOCKS_SQL}, b AS (SELECT * FROM fx_blocks WHERE i > 0), n AS (SELECT doc_id, max(contains(original_text, 'License')) AS marked, count(*) FILTER (page_number = 1) AS first FROM b GROUP BY doc_id), m AS (SELECT doc_id, count(*) FILTER (page_number > 1) AS later FROM b GROUP BY doc_id) SELECT d.doc_id, (d.doc_id % 2 = 0 AND coalesce(first, 0) = 0 AND coalesce(later, 0) = 0) OR coalesce(marked, false) AS needs_reading FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)")
def needs_reading(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), F.when(F.col("doc_id") % 2 == 1, "page.png").alias("raster_path"))
    return display.needs_reading(pages, blocks(spark, sf_dir).where("i > 0"), mark="License")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, coalesce(max(CASE WHEN page_number = 2 THEN 2 END), min(page_number))::INT AS page_number FROM fx_blocks GROUP BY doc_id")
def page_or_first(spark, sf_dir):
    return display.page_or_first(blocks(spark, sf_dir), 2)


@query("SELECT doc_id, n_chars, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN round(n_chars / 1024, 1)::DOUBLE::VARCHAR || ' KB' ELSE round(n_chars / 1048576, 1)::DOUBLE::VARCHAR || ' MB' END AS size FROM documents ORDER BY n_chars DESC, doc_id LIMIT 6")
def recent_documents(spark, sf_dir):
    return display.recent(table(spark, sf_dir, "documents").select("doc_id", "n_chars", display.byte_text(F.col("n_chars")).alias("size")), "n_chars", "doc_id")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, layout_type FROM fx_blocks WHERE layout_type = 'heading'")
def blocks_of_type(spark, sf_dir):
    return B.of_type(blocks(spark, sf_dir), "heading").select("doc_id", "i", "layout_type")


_CLAMPED = "greatest(trunc({0}), 0)::INT AS x1, greatest(trunc({1}), 0)::INT AS y1, least(trunc({2}), 612)::INT AS x2, least(trunc({3}), 792)::INT AS y2"


def _clamped(x1: str, y1: str, x2: str, y2: str) -> str:
    return _CLAMPED.format(x1, y1, x2, y2)


def _rects(b: DataFrame, rects) -> DataFrame:
    return b.select("doc_id", "i", F.posexplode(rects).alias("k", "r")).select("doc_id", "i", "k", "r.*")


def _stored(b: DataFrame) -> DataFrame:
    """Every second block has a stored box."""
    own = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")))
    return b.withColumn("boxes", F.when(F.col("i") % 2 == 1, F.array(own)).otherwise(F.slice(F.array(own), 1, 0)))


@query(f"WITH {BLOCKS_SQL}, p AS (SELECT *, greatest(2, trunc(font_size * 0.22::DOUBLE)) AS pad, greatest(1, trunc(width * 0.02::DOUBLE)) AS dx, greatest(1, trunc(height * 0.06::DOUBLE)) AS dy FROM fx_blocks) SELECT doc_id, i, 0 AS k, {_clamped('CASE WHEN i % 2 = 1 THEN x - pad ELSE x + dx END', 'CASE WHEN i % 2 = 1 THEN y - pad ELSE y + dy END', 'CASE WHEN i % 2 = 1 THEN x + width + pad ELSE x + width - dx END', 'CASE WHEN i % 2 = 1 THEN y + height + pad ELSE y + height - dy END')} FROM p")
def tight_rects(spark, sf_dir):
    b = _stored(blocks(spark, sf_dir))
    return _rects(b, E.tight_rects(F.col("boxes"), G.box(), F.col("font_size"), F.lit(PAGE_W), F.lit(PAGE_H)))


@query(f"WITH a AS ({ORACLES['stored_erase_rects']}), b AS ({ORACLES['erase_rects']}) SELECT doc_id, i, 0 AS k, x1, y1, x2, y2 FROM a WHERE i % 2 = 1 UNION ALL SELECT doc_id, i, (i % 2)::INT, x1, y1, x2, y2 FROM b")
def text_rects(spark, sf_dir):
    b = _stored(blocks(spark, sf_dir))
    return _rects(b, E.text_rects(F.col("boxes"), G.box(), F.col("font_size"), F.lit(PAGE_W), F.lit(PAGE_H)))


_GRID = "array(array('a', 'b', 'c'), array('d'))"
_CELLS = "array<struct<x:double,y:double,width:double,height:double,font_size:double>>"


@query(f"WITH {BLOCKS_SQL}, g AS (SELECT *, CASE WHEN i % 2 = 0 THEN width / 3::DOUBLE ELSE 50 END AS w0, CASE WHEN i % 2 = 0 THEN width / 3::DOUBLE ELSE 60 END AS w1, width / 3::DOUBLE AS w2, height / 2::DOUBLE AS h FROM fx_blocks), c AS (SELECT *, k % 3 AS c, k // 3 AS r, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN w0 ELSE w0 + w1 END AS dx, CASE k % 3 WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END AS cw FROM g, range(6) t(k)) SELECT doc_id, i, k::INT AS k, {_clamped('x + dx + 3', 'y + r * h + 3', 'x + dx + cw - 3', 'y + (r + 1) * h - 3')} FROM c")
def table_grid_rects(spark, sf_dir):
    widths = F.when(F.col("i") % 2 == 1, F.array(F.lit(50.0), F.lit(60.0)))
    r = E.table_rects(F.array().cast(_CELLS), F.expr(_GRID), G.box(), F.lit(PAGE_W), F.lit(PAGE_H), widths)
    return _rects(blocks(spark, sf_dir), r)


@query(f"WITH {BLOCKS_SQL}, p AS (SELECT *, greatest(4, trunc(font_size * 0.35::DOUBLE)) AS pad FROM fx_blocks), q AS (SELECT doc_id, i, {_clamped('x - greatest(pad, width * 0.05::DOUBLE)', 'y - greatest(pad, height * 0.10::DOUBLE)', 'x + width + greatest(pad, width * 0.05::DOUBLE)', 'y + height + greatest(pad, height * 0.10::DOUBLE)')} FROM p) SELECT doc_id, i, 0 AS k, x1 + 3 AS x1, y1 + 3 AS y1, x2 - 3 AS x2, y2 - 3 AS y2 FROM q")
def table_cell_rects(spark, sf_dir):
    cells = F.array(F.struct("x", "y", "width", "height", "font_size")).cast(_CELLS)
    return _rects(blocks(spark, sf_dir), E.table_rects(cells, F.expr(_GRID), G.box(), F.lit(PAGE_W), F.lit(PAGE_H)))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, k::INT AS k, {_clamped('x + k % 3 * (width / 3::DOUBLE) + 4', 'y + k // 3 * (height / 2::DOUBLE) + 4', 'x + (k % 3 + 1) * (width / 3::DOUBLE) - 4', 'y + (k // 3 + 1) * (height / 2::DOUBLE) - 4')} FROM fx_blocks, range(6) t(k)")
def cell_insides(spark, sf_dir):
    return _rects(blocks(spark, sf_dir), E.cell_rects(F.array().cast(_CELLS), F.expr(_GRID), G.box(), F.lit(PAGE_W), F.lit(PAGE_H)))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, 0 AS k, {_clamped('x - 60', 'y - 60', 'x + width + 60', 'y + height + 60')} FROM fx_blocks")
def padded_rects(spark, sf_dir):
    b = blocks(spark, sf_dir)
    whole = F.array(F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2")))
    return _rects(b, G.padded_rects(whole, F.lit(PAGE_W), F.lit(PAGE_H), 60))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, x::DOUBLE AS x, y::DOUBLE AS y, CASE WHEN i % 2 = 0 THEN width ELSE 5 END::DOUBLE AS width, height::DOUBLE AS height FROM fx_blocks")
def span_boxes(spark, sf_dir):
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "width", "height"))
    corners = F.when(F.col("i") % 2 == 0, F.array(x, y, x + w, y + h)).otherwise(F.array(x, y, F.lit(5.0), h))
    return blocks(spark, sf_dir).select("doc_id", "i", E.span_box(corners).alias("b")).select("doc_id", "i", "b.*")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, CASE WHEN i % 2 = 0 THEN font_size::DOUBLE ELSE round(({SIZE})::DECIMAL(20,15), 1)::DOUBLE END AS font_size, CASE WHEN i % 2 = 0 THEN 'bold' WHEN layout_type = 'heading' THEN 'bold' ELSE 'normal' END AS font_weight, 'Foo' AS font_family, '#000000' AS color, 'italic' AS font_style FROM fx_blocks")
def span_styles(spark, sf_dir):
    even = F.col("i") % 2 == 0
    span = F.struct(F.when(even, F.col("font_size").cast("double")).alias("font_size"), F.when(even, "bold").alias("font_weight"), F.lit("Foo").alias("font_family"), F.lit(None).cast("string").alias("color"), F.lit("italic").alias("font_style"))
    style = S.span_style(S.infer_style(G.box(), F.col("layout_type"), PAGE_W, F.lit("en")), span)
    return blocks(spark, sf_dir).select("doc_id", "i", *(style[k].alias(k) for k in ("font_size", "font_weight", "font_family", "color", "font_style")))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'it' THEN 'Italian' WHEN 'pt' THEN 'Portuguese' WHEN 'nl' THEN 'Dutch' WHEN 'pl' THEN 'Polish' WHEN 'ru' THEN 'Russian' WHEN 'ar' THEN 'Arabic' WHEN 'zh' THEN 'Chinese' WHEN 'ja' THEN 'Japanese' WHEN 'ko' THEN 'Korean' WHEN 'hi' THEN 'Hindi' WHEN 'tr' THEN 'Turkish' ELSE lang END AS label, CASE WHEN doc_id % 3 = 0 THEN 'Foo' WHEN lang IN ('ar', 'fa', 'ur', 'he') THEN 'DecoType Naskh' ELSE 'Helvetica' END AS font, lang IN ('en', 'fr') AS installed FROM documents")
def language_names(spark, sf_dir):
    there = F.array(F.lit("en"), F.lit("fr:latest"), F.lit("deu"))
    asked = F.when(F.col("doc_id") % 3 == 0, "Foo")
    return table(spark, sf_dir, "documents").select("doc_id", P.language_label(F.col("lang")).alias("label"), P.font_for(asked, F.col("lang")).alias("font"), P.model_installed(F.col("lang"), there).alias("installed"))


@query(f"WITH {HTML_SQL} SELECT page_id, string_agg(element_type || '@40,' || y, ', ' ORDER BY k) AS regions FROM fx_html WHERE k < 20 GROUP BY page_id")
def region_summary(spark, sf_dir):
    r = html_regions(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", "element_type", "x", "y"))).alias("r"))
    return r.select("page_id", P.region_summary(F.col("r")).alias("regions"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with recognised paragraphs; those of even blocks have two lines without words."""
    place = [F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]
    text = F.col("original_text")
    line = lambda t: F.struct(t.alias("text"), F.col("confidence"), *place, F.array().cast(f"array<{recognised.WORD}>").alias("words"))
    lines = F.when(F.col("i") % 2 == 0, F.array(line(F.substring(text, 1, 10)), line(F.substring(text, 11, 1 << 20))))
    p = F.struct(text.alias("text"), F.col("confidence"), *place, F.col("i").alias("reading_order"), lines.alias("lines")).cast(recognised.PARAGRAPH)
    b = blocks(spark, sf_dir).select("doc_id", "page_number", "i", p.alias("p"))
    return b.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("paragraphs"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page_number, count(*) AS n_paragraphs, sum(CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS n_lines, sum(i % 2)::BIGINT AS n_words, string_agg(CASE WHEN i % 2 = 0 THEN left(original_text, 10) || '|' || substring(original_text, 11) ELSE original_text END, '|' ORDER BY i) AS texts FROM fx_blocks GROUP BY ALL")
def recognised_flat(spark, sf_dir):
    f = _paragraphs(spark, sf_dir).withColumn("f", recognised.flattened(F.col("paragraphs")))
    size = lambda c: F.size(c).cast("long")
    return f.select("doc_id", "page_number", size("f.paragraphs").alias("n_paragraphs"), size("f.lines").alias("n_lines"), size("f.words").alias("n_words"), F.array_join(F.col("f.lines.text"), "|").alias("texts"))


@query(f"WITH {BLOCKS_SQL}, r AS (SELECT doc_id, i, unnest(CASE WHEN i % 3 = 0 THEN ['run'] WHEN i % 3 = 1 THEN [left(original_text, 10), substring(original_text, 11)] ELSE [original_text] END) AS text, unnest(range(CASE WHEN i % 3 = 1 THEN 2 ELSE 1 END)) AS k, CASE WHEN i % 3 = 2 THEN 1.0 ELSE confidence END AS confidence FROM fx_blocks) SELECT doc_id, i, k::INT AS k, text, confidence::DOUBLE AS confidence FROM r")
def inline_runs(spark, sf_dir):
    text, kind = F.col("original_text"), F.col("i") % 3
    place = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")))
    one = lambda t: F.struct(t.alias("text"), F.col("confidence"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")))
    runs, lines = F.when(kind == 0, F.array(one(F.lit("run")))), F.when(kind == 1, F.array(one(F.substring(text, 1, 10)), one(F.substring(text, 11, 1 << 20))))
    b = blocks(spark, sf_dir).select("doc_id", "i", F.posexplode(recognised.inline_runs(runs, lines, text, place)).alias("k", "r"))
    return b.select("doc_id", "i", "k", "r.text", "r.confidence")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page_number, true AS equal FROM fx_blocks GROUP BY ALL")
def cache_round_trip(spark, sf_dir):
    from ..sources.ingest import json_round_trip

    whole = F.struct("page_number", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), "paragraphs").cast(recognised.RECOGNISED)
    return _paragraphs(spark, sf_dir).select("doc_id", "page_number", json_round_trip(whole, recognised.RECOGNISED).eqNullSafe(whole).alias("equal"))


@query(f"WITH {BLOCKS_SQL}, b AS (SELECT *, CASE WHEN i % 2 = 1 THEN width + 700 ELSE width END AS w, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY i) - 1 AS k FROM fx_blocks) SELECT doc_id, page_number, k::INT AS k, CASE layout_type WHEN 'heading' THEN 'unknown' ELSE layout_type END AS element_type, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS width, height::DOUBLE AS height, confidence::DOUBLE AS confidence, trim(original_text) AS text, NULL AS rows FROM b")
def structure_parse(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    bbox, text = F.when(F.col("i") % 2 == 1, F.array(x, y, x + w + 700, y + h)).otherwise(F.array(x, y, w, h)), F.col("original_text")
    one = F.struct(F.col("layout_type").alias("label"), bbox.alias("bbox"), F.col("confidence").alias("score"), F.when(F.col("i") % 3 == 0, text).alias("text"), F.when(F.col("i") % 3 != 0, F.struct(text.alias("content"))).alias("res"))
    pages = blocks(spark, sf_dir).groupBy("doc_id", "page_number").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("i", one.alias("b")))), lambda s: s["b"]).alias("layout"))).alias("content"))
    found = structure.structure(pages, "content", F.lit(float(PAGE_W)), F.lit(float(PAGE_H)))
    return found.withColumn("rows", F.to_json("rows"))


@query(f"WITH s AS ({ORACLES['sections']}), {HTML_SQL} SELECT page_id, section, max(section_kind) AS section_kind, string_agg(k, ',' ORDER BY y, x, k) AS members FROM s JOIN fx_html USING (page_id, k) GROUP BY page_id, section")
def section_members(spark, sf_dir):
    m = vision.section_members(vision.sections(html_regions(spark, sf_dir), ["page_id"], "k"), ["page_id"], "k")
    return m.select("page_id", "section", "section_kind", F.array_join(F.transform("members", lambda v: v.cast("string")), ",").alias("members"))


@query(f"SELECT page_id, k, section FROM ({ORACLES['sections']}) WHERE k % 2 = 0")
def section_blocks(spark, sf_dir):
    r = html_regions(spark, sf_dir)
    m = vision.section_members(vision.sections(r, ["page_id"], "k"), ["page_id"], "k")
    return vision.blocks_by_section(r.where("k % 2 = 0"), m, ["page_id"], "k").select("page_id", "k", "section")


@query(f"WITH {BLOCKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y, x, i) - 1 AS n, doc_id % 3 <> 0 AS hinted FROM fx_blocks), c AS (SELECT n.*, column_count AS cc, column_index AS ci FROM n JOIN ({ORACLES['columns']}) USING (doc_id, i)) SELECT doc_id, i, CASE WHEN hinted AND n = 0 THEN 0.75 WHEN layout_type = 'heading' THEN 0.9 WHEN layout_type = 'footer' THEN 0.3 ELSE 0.5 END::DOUBLE AS importance, CASE WHEN hinted AND n = 1 THEN 7 WHEN layout_type = 'heading' THEN 1 WHEN layout_type = 'footer' THEN 0 ELSE 3 END AS hierarchy_level, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE cc END AS column_count, CASE WHEN NOT hinted THEN ci WHEN (doc_id % 3 = 1 OR cc > 1) AND x + width / 2 > 306 THEN 1 ELSE 0 END AS column_index FROM c")
def vision_hints(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("element_type", F.col("layout_type"))
    note = F.expr("array(named_struct('index', 0, 'importance', 0.25D, 'hierarchy_level', int(null)), named_struct('index', 1, 'importance', double(null), 'hierarchy_level', 7), named_struct('index', 0, 'importance', 0.75D, 'hierarchy_level', int(null)))")
    hints = b.select("doc_id", "page_number").distinct().where("doc_id % 3 <> 0").withColumns({"column_count": F.when(F.col("doc_id") % 3 == 1, 2), "notes": note})
    rows = vision.document_map(b, B.PAGE, "i", PAGE_W)
    return vision.merge_hints(rows, hints, B.PAGE, "i", PAGE_W).select("doc_id", "i", "importance", "hierarchy_level", "column_count", "column_index")


@query(f"WITH m AS ({ORACLES['columns']}), {BLOCKS_SQL} SELECT b.doc_id, b.i, m.column_index FROM fx_blocks b LEFT JOIN m ON m.doc_id = b.doc_id AND m.i = b.i AND b.i % 2 = 0")
def block_vision(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("rid", F.when(F.col("i") % 2 == 0, F.col("i")))
    found = vision.columns(b.withColumn("rid", F.col("i")), B.PAGE, PAGE_W)
    return vision.with_vision(b, found, B.PAGE, "rid", ["column_index"]).select("doc_id", "i", "column_index")


@query(f"WITH {BLOCKS_SQL}, d AS (SELECT doc_id, string_agg(original_text, chr(10) ORDER BY i) AS text FROM fx_blocks GROUP BY doc_id) {ORACLES['language_detect'].replace('WITH s AS', ', s AS', 1).replace('FROM documents', 'FROM d', 1)}".replace("GROUP BY doc_id) , s", "GROUP BY doc_id), s"))
def document_language(spark, sf_dir):
    return B.document_language(blocks(spark, sf_dir), ["i"])


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, count(*) AS blocks, sum((i % 5 = 0)::INT)::BIGINT AS failed FROM fx_blocks GROUP BY doc_id")
def batch_failures(spark, sf_dir):
    return B.batch_failures(blocks(spark, sf_dir).withColumn("failed", F.col("i") % 5 == 0))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, i, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY i % 3, y, x, i) - 1)::INT AS paint_order FROM fx_blocks")
def paint_order(spark, sf_dir):
    b = B.reading_order(blocks(spark, sf_dir), "i").withColumn("z_index", F.col("i") % 3)
    return B.paint_order(b, "i").select("doc_id", "i", "paint_order")


@query(f"WITH {REGIONS_SQL} SELECT doc_id, page_number, rid FROM fx_regions WHERE element_type <> 'figure' AND page_number IN (1, 3)")
def text_regions(spark, sf_dir):
    return B.pages_of(B.text_regions(regions(spark, sf_dir)), [1, 3]).select("doc_id", "page_number", "rid")


@query(f"WITH {BLOCKS_SQL}, p AS (SELECT DISTINCT doc_id, page_number FROM fx_blocks) SELECT doc_id, sum(page_number % 2)::BIGINT AS rebuilt, count(*) AS page_count FROM p GROUP BY doc_id")
def rebuilt_pages(spark, sf_dir):
    p = blocks(spark, sf_dir).select("doc_id", "page_number").distinct()
    return B.rebuilt_share(p.withColumn("translated_path", F.when(F.col("page_number") % 2 == 1, "p.png")))


@query("WITH p AS (SELECT user_id, event_type, round(sum(value), 3) AS ms, count(*) FILTER (event_id % 2 = 0) AS hits FROM events GROUP BY ALL) SELECT user_id, count(*) AS stages, round(sum(ms), 3) AS total_ms, sum(hits)::BIGINT AS cache_hits, string_agg(event_type, ',' ORDER BY event_type) AS names FROM p GROUP BY user_id")
def timing_map(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("hit", F.col("event_id") % 2 == 0)
    t = quality.timing_map(e, "user_id", "event_type", "value", "hit")
    return t.select("user_id", F.size("timings").cast("long").alias("stages"), F.round(F.aggregate(F.map_values("timings"), F.lit(0.0), lambda a, v: a + v), 3).alias("total_ms"), "cache_hits", F.array_join(F.map_keys("timings"), ",").alias("names"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, doc_id || '_translated_semantic.txt' AS filename, string_agg(coalesce(nullif(translated_text, ''), original_text), chr(10) ORDER BY page_number, y, x, i) AS content FROM fx_blocks GROUP BY doc_id")
def text_export(spark, sf_dir):
    return providers.export(B.reading_order(blocks(spark, sf_dir), "i"), "txt")
