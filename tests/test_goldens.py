"""Exact values from FIXTURES.md, and folds against plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import geometry as G
from docweave.functions import style as S
from docweave.functions import text as T
from docweave.operators import blocks as B
from docweave.operators import grouping, quality, spatial
from docweave.operators.translate import REGISTRY, translate_blocks


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lit_box(x, y, w, h):
    return G.Box(*(F.lit(float(v)) for v in (x, y, w, h)))


@pytest.mark.parametrize(("a", "b", "want"), [((0, 0, 100, 100), (50, 50, 100, 100), 0.14285714285714285), ((0, 0, 9, 9), (0, 0, 9, 9), 1.0), ((0, 0, 5, 5), (50, 50, 5, 5), 0.0), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)])
def test_iou(spark, a, b, want):
    assert one(spark, G.iou(lit_box(*a), lit_box(*b)))[0] == want


def test_boxes(spark):
    assert tuple(one(spark, *G.expanded(lit_box(10, 10, 50, 50), 20, F.lit(200), F.lit(200)))) == (0, 0, 90, 90)
    w = one(spark, G.word_boxes(F.lit("Hello world"), lit_box(10, 20, 100, 16)))[0]
    assert [(r.text, r.x, r.width) for r in w] == [("Hello", 10, 51.690821256038646), ("world", 61.690821256038646, 48.309178743961354)]
    assert one(spark, G.contains_point(lit_box(0, 0, 5, 5), F.lit(5), F.lit(5)))[0]
    poly = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((3, 4), (9, 1), (5, 8))))
    assert tuple(one(spark, *G.from_polygon(poly))) == (3, 1, 6, 7)
    r = one(spark, G.pixel_rect(lit_box(-3.7, 5.9, 10, 10), F.lit(100), F.lit(12)))[0]
    assert tuple(r) == (0, 5, 6, 12)


def test_style(spark):
    st_ = S.infer_style(lit_box(50, 50, 400, 36), F.lit("heading"), F.lit(612.0), F.lit("en"))
    assert tuple(one(spark, *st_.values())) == (41.3, 49.6, "bold", "center", "ltr")
    assert one(spark, T.max_chars(F.lit(200.0), F.lit(40.0), F.lit(12.0)))[0] == 60
    assert one(spark, S.rtl_alignment(F.lit("left"), F.lit("ar")), S.rtl_alignment(F.lit("left"), F.lit("en"))) == ("right", "left")
    assert one(spark, S.color_hex(F.lit(0xFF8000)), S.color_rgb(F.lit("#ff8000")), S.color_rgb(F.lit("x"))) == ("#ff8000", [255, 128, 0], [0, 0, 0])


@pytest.mark.parametrize(("text", "want"), [("", "en"), (None, "en"), ("short", "en"), ("Это русский текст", "ru"), ("هذا نص عربي طويل", "ar"), ("这是一个中文的句子啊啊", "zh"), ("これはとても日本語です", "ja"), ("이것은 한국어 문장입니다", "ko"), ("Ceci est écrit", "en")])
def test_language(spark, text, want):
    assert one(spark, T.detect_language(F.lit(text).cast("string")))[0] == want


def test_placeholders(spark):
    text = "Dear {name}, see [[x]] and pay $1,200 by 12/05/2024 in 1999 to @a.b now " + " ".join(str(2000 + i) for i in range(12))
    p = one(spark, T.protect(F.lit(text)).alias("p")).p
    assert p.kept[:6] == ["{name}", "[[x]]", "$1,200", "12/05/2024", "1999", "@a.b"] and len(p.kept) == 18
    kept = F.array(*map(F.lit, p.kept))
    assert one(spark, T.unprotect(F.lit(p.text), kept))[0] == text
    assert one(spark, T.unprotect(F.lit("__KEEP_10__ KEEP_1"), kept))[0] == f"{p.kept[10]} {p.kept[1]}"


def test_glossary(spark):
    terms = F.array(*(F.struct(F.lit(a).alias("term"), F.lit(b).alias("translation")) for a, b in (("cat", "chat"), ("cat flap", "chatière"), ("dog", "chien"))))
    w = one(spark, T.wrap_terms(F.lit("the cat flap and a cat"), terms).alias("w")).w
    assert w.text == "the __GLOSS_0__ and a __GLOSS_1__" and w.used == ["chatière", "chat"]
    assert one(spark, T.unwrap_terms(F.lit(w.text), F.array(*map(F.lit, w.used))))[0] == "the chatière and a chat"


def test_markup(spark):
    html = "<table><tr><th>A</th><TD> <b>1</b> </TD></tr><tr></tr><tr><td>x\ny</td></tr></table>"
    assert one(spark, T.html_table_rows(F.lit(html)))[0] == [["A", "1"], ["x\ny"]]
    assert one(spark, T.html_escape(F.lit("<a b=\"c\">&'</a>")))[0] == "&lt;a b=&quot;c&quot;&gt;&amp;&#x27;&lt;/a&gt;"
    for content, want in (('"hi"', "hi"), ('{"translated": "ok"}', "ok"), ('{"translation": " ", "text": "t"}', "t"), ('{"translations": ["z"]}', "z"), ("{}", None)):
        assert one(spark, T.parse_translation(F.lit(content)))[0] == want
    assert one(spark, T.first_json(F.lit('so {"a": {"b": 1}} end')))[0] == '{"a": {"b": 1}}'


def test_qa(spark):
    q = lambda o, b, t: one(spark, T.qa_score(F.lit(o), F.lit(b), F.lit(t).cast("string")))[0]
    assert [q("A b", "a b ", "x"), q("a b c", "b c", "x"), q("a b c d", "a x y d", "x"), q("a", "a", None)] == [1.0, 0.75, 0.5, 0.0]


def boxes(spark, rows, fields="id int, x double, y double, width double, height double"):
    return spark.createDataFrame([(1, 1, *r) for r in rows], f"doc_id int, page_number int, {fields}").groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct(*(f.split()[0] for f in fields.split(", "))))).alias("boxes"))


def test_lines_and_paragraphs(spark):
    page = boxes(spark, [(i, 10.0, 18.0 * i, 100.0, 14.0) for i in range(20)])
    lines = page.select(F.explode(grouping.line_numbers(F.col("boxes"))).alias("r")).select("r.*").collect()
    assert len({r.line for r in lines}) == 20
    got = page.select(F.explode(grouping.paragraph_numbers(F.col("boxes"))).alias("r")).groupBy("r.paragraph").count().orderBy("paragraph").collect()
    assert [r[1] for r in got] == [8, 8, 4]


def plain_lines(rows):
    order = sorted(rows, key=lambda r: (r[2] + r[4] / 2, r[1]))
    h = sorted(r[4] for r in rows if r[4] > 0)
    tol, c, n, out = max(6, 0.55 * (h[len(h) // 2] if h else 16.0)), None, -1, {}
    for r in order:
        y = r[2] + r[4] / 2
        if c is not None and abs(y - c) <= tol:
            c = (c + y) / 2
        else:
            n, c = n + 1, y
        out[r[0]] = n
    return out


def test_lines_match_plain_python(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [(i, rng.uniform(0, 500), rng.uniform(0, 300), rng.uniform(5, 60), rng.choice([0.0, 8.0, 12.0, 20.0])) for i in range(60)]
        got = boxes(spark, rows).select(F.explode(grouping.line_numbers(F.col("boxes"))).alias("r")).select("r.*").collect()
        assert {r.id: r.line for r in got} == plain_lines(rows)


def py_iou(a, b):
    i = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])) * max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    u = a[3] * a[4] + b[3] * b[4] - i
    return i / u if u > 0 else 0


def test_suppression(spark):
    rng = random.Random(8)
    rows = [(i, rng.uniform(0, 90), rng.uniform(0, 90), 40.0, 30.0, float(rng.randint(0, 9))) for i in range(50)]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[0], r[2], r[1])):
        if all(py_iou(r, k) < 0.45 for k in kept):
            kept.append(r)
    page = boxes(spark, rows, "id int, x double, y double, width double, height double, score double")
    once = page.select(grouping.suppress(F.col("boxes")).alias("boxes"))
    assert [b.id for b in once.first().boxes] == [k[0] for k in kept]
    assert once.select(grouping.suppress(F.col("boxes")).alias("b")).first().b == once.first().boxes


def test_erase_boxes(spark):
    page = boxes(spark, [(0, 1.0, 2.0, 10.0, 8.0), (1, 1.1, 2.1, 10.0, 8.0), (2, 50.0, 2.0, 10.0, 8.0), (3, 0.0, 0.0, 0.0, 5.0)])
    assert [b.id for b in page.select(grouping.dedupe_boxes(F.col("boxes")).alias("b")).first().b] == [0, 2]


def test_merge_of_recognisers(spark):
    f = "id int, x double, y double, width double, height double, score double, text string"
    p = [(i, 10.0, 40.0 * i, 200.0, 20.0, 1.0, "short text") for i in range(2)]
    s = [(10 + i, 10.0, 40.0 * i, 200.0, 20.0, 2.0, "a rather longer supplemental line") for i in range(4)]
    both = boxes(spark, p, f).withColumnRenamed("boxes", "p").join(boxes(spark, s, f).withColumnRenamed("boxes", "s"), ["doc_id", "page_number"])
    ids = lambda a, b: [x.id for x in both.select(grouping.merge_detections(F.col(a), F.col(b)).alias("m")).first().m]
    assert ids("p", "s") == [10, 11, 12, 13] and ids("s", "p") == [0, 1, 12, 13]


def test_emit_image(spark):
    fig = spark.createDataFrame([(1, 1, 1, 0, 0, 1000, 1400)], "doc_id int, page_number int, rid int, x int, y int, width int, height int")
    paras = spark.createDataFrame([(1, 1, 50, 100 * i, 600, 40, "some text here") for i in range(3)], "doc_id int, page_number int, x int, y int, width int, height int, original_text string")
    assert not spatial.emit_images(fig, paras, 1000 * 1400).first().emit
    assert spatial.emit_images(fig, paras.limit(0), 1000 * 1400).first().emit


def test_reflow(spark):
    text = "This is a much longer translated sentence that needs additional lines xx"
    h = S.composed_height(lit_box(10, 10, 200, 30), F.lit("short"), F.lit(text), F.lit(12.0), F.lit(14.4), F.lit(800.0))
    assert one(spark, h)[0] >= 30


def test_quality(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    b = spark.createDataFrame([(1, 0.5, 0.9, "x" * 20, True, 10), (1, 1.0, None, None, False, 10)], "doc_id int, confidence double, translation_confidence double, translated_text string, is_edited boolean, max_chars int")
    got = {r.doc_id: r for r in quality.gates(quality.quality_scores(docs, b)).collect()}
    assert (got[1].ocr_confidence, got[1].translation_qa, got[1].overflow_count, got[1].layout_quality, got[1].warnings) == (0.75, 0.9, 1, 0.95, ["overflow"])
    assert (got[2].ocr_confidence, got[2].source_text_residual, got[2].warnings) == (0.0, 1.0, ["residual", "layout"])


def test_grid_and_uploads(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 2, "b"), (1, 1, 2, "c")], "t int, row int, col int, text string")
    assert B.dense_grid(cells, ["t"]).first().rows == [["a", "", ""], ["", "", "b"]]
    up = spark.createDataFrame([("a.PDF", "application/pdf", 5), ("b.exe", "image/png", 5), ("c.png", "text/plain", 5), ("d.png", "image/png", 1 << 30)], "path string, mime string, length long")
    assert [r.reason for r in B.admit_uploads(up).collect()] == [None, "extension", "type", "size"]


class _Odd:
    name = "odd"

    def translate(self, texts, source, target):
        if len(texts) > 1 or texts[0] == "bad":
            raise RuntimeError
        return [t.upper() for t in texts]


def test_failures_stay_apart(spark):
    b = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "c"])], "i int, original_text string").coalesce(1)
    assert [(r.translated_text, r.failed) for r in translate_blocks(b, "noop", "en", "fr").collect()] == [("a", False), ("bad", False), ("c", False)]
    assert "noop" in REGISTRY


def test_progress_stream(spark, tmp_path):
    import json

    from docweave.streaming.progress import latest, read_progress

    src = tmp_path / "in"
    src.mkdir()
    rows = [{"document_id": d, "stage": s, "elapsed_ms": e, "progress": p, "message": ""} for d, s, e, p in ((1, "ocr", 5, 0.2), (1, "merge", 9, 0.6), (2, "ocr", 3, 0.1))]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = latest(read_progress(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("progress_t").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.document_id, r.stage, r.events) for r in spark.table("progress_t").collect()} == {(1, "merge", 2), (2, "ocr", 1)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 50)] * 4), min_size=2, max_size=2))
def test_iou_is_symmetric_and_bounded(pair):
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    if s is None:
        pytest.skip("no session")
    a, b = (lit_box(*p) for p in pair)
    x, y = one(s, G.iou(a, b), G.iou(b, a))
    assert x == y and 0 <= x <= 1


def test_document_round_trip(spark, tmp_path):
    from docweave.sources.store import DOCUMENT, nest, read_documents, unnest, write_documents

    docs = spark.createDataFrame([], DOCUMENT)
    row = docs.unionByName(spark.sql("SELECT 'd1' AS id, 'n' AS name"), allowMissingColumns=True)
    write_documents(row.coalesce(1), str(tmp_path / "d"))
    back = read_documents(spark, str(tmp_path / "d")).collect()
    assert [(r.id, r.schema_version) for r in back] == [("d1", "2.0.0")]
    blocks = spark.createDataFrame([("d", 1, 1, "b"), ("d", 1, 0, "a")], "doc_id string, page_number int, reading_order int, text string")
    pages = spark.createDataFrame([("d", 1, 600.0), ("d", 2, 600.0)], "doc_id string, page_number int, width double")
    n = nest(blocks, pages)
    assert n.first().page_count == 2 and [r.text for r in unnest(n, "doc_id").collect()] == ["a", "b"]
