from pyspark.sql import functions as F

from docweave.functions import geometry as G
from docweave.functions import style as S
from docweave.operators import tables as TB
from docweave.sources import ingest as I


def test_spans(spark):
    raw = spark.createDataFrame([("  Hi ", 0.0, 0.0, 72.0, 12.0, 12.0, "ABC+Foo-BoldOblique", 0, 255), ("  ", 0.0, 0.0, 1.0, 1.0, 1.0, "x", 0, 0), ("i", 0.0, 0.0, 1.0, 1.0, None, "x", 18, None)], "text string, x0 double, y0 double, x1 double, y1 double, size double, font string, flags int, color int")
    a, b = I.spans(raw, 144).collect()
    assert (a.text, a.width, a.font_size, a.font_family, a.color, a.font_weight, a.font_style) == ("Hi", 144.0, 24.0, "Foo-BoldOblique", "#0000ff", "bold", "italic")
    assert (b.font_size, b.color, b.font_weight, b.font_style) == (24.0, "#000000", "bold", "italic")


def test_names(spark):
    got = spark.createDataFrame([("Plain Text",), ("figure_caption",), ("xyz",)], "n string").select(I.element_type(F.col("n")), I.label_type(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("paragraph", "unknown"), ("figure", "caption"), ("unknown", "unknown")]


def test_fallbacks(spark):
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0), (1, 2, 600.0, 800.0)], "doc_id int, page_number int, width double, height double")
    regions = spark.createDataFrame([(1, 1, 5, 0.0, 0.0, 9.0, 9.0, "table")], "doc_id int, page_number int, rid int, x double, y double, width double, height double, element_type string")
    got = {r.page_number: r for r in I.with_fallback_region(pages, regions).collect()}
    assert got[1].rid == 5 and (got[2].x, got[2].width, got[2].height) == (40, 520, 720)
    paras = spark.createDataFrame([(1, 1, "t", 0.5)], "doc_id int, page_number int, text string, confidence double")
    assert sorted(r.confidence for r in I.with_unread_marker(pages, paras, "none").collect()) == [0.0, 0.5]
    p = lambda t: paras.limit(0).unionByName(spark.createDataFrame([(1, 1, t, 1.0), (1, 2, t, 1.0)], paras.schema))
    assert {(r.page_number, r.text) for r in I.source_paragraphs(p("s"), p("r"), p("w"), regions).collect()} == {(1, "r"), (2, "s")}


def test_batch_answers(spark):
    q = lambda t, n: spark.range(1).select(I.batch_answers(F.lit(t), F.lit(n))).first()[0]
    assert q('["a", " b "]', 2) == ["a", "b"] and q('["a"]', 2) is None
    assert q('{"translations": ["x", "y"]}', 2) == ["x", "y"]
    assert q('{"translations": [{"id": 1, "translation": "b"}, {"id": 0, "text": "a"}]}', 2) == ["a", "b"]
    assert q('{"translations": [{"id": 1, "text": "b"}]}', 2) is None and q("nonsense", 1) is None


def test_tables(spark):
    t = spark.createDataFrame([(1, [["a", " "], ["b", "c"]])], "t int, rows array<array<string>>")
    a = spark.createDataFrame([(1, 0, 0, "A"), (1, 1, 1, "")], "t int, row int, col int, translation string")
    r = TB.translated_rows(t, a, ["t"]).first()
    assert r.translated_rows == [["A", " "], ["b", "c"]]
    box = G.Box(F.lit(10), F.lit(20), F.lit(100), F.lit(40))
    rects = t.select(TB.cell_rects(F.col("rows"), box).alias("r")).first().r
    assert [tuple(x) for x in rects] == [(0, 0, 13, 23, 57, 37), (0, 1, 63, 23, 107, 37), (1, 0, 13, 43, 57, 57), (1, 1, 63, 43, 107, 57)]
    g = t.select(*(c.alias(k) for k, c in TB.geometry(F.array(F.array(F.lit("a" * 30))), F.col("rows"), box).items())).first()
    assert g.col_widths == [100.0] and g.row_heights == [400.0]


def test_wrap_and_fit(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.wrapped_lines(F.lit("aa bbb abcdefgh c"), F.lit(50.0), F.lit(10.0))) == ["aa", "bbb", "abcde", "fgh c"]
    b = G.Box(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(26.0))
    assert one(S.fitted_font_size(F.lit("word " * 6), b, F.lit(12.0), F.lit(7.0))) <= 12
    assert one(S.target_family(F.lit("Times New"), F.lit("bold"), F.lit("ar"))) == "DecoType Naskh Bold"
    assert one(S.arabic_capable(F.lit("Noto Naskh"))) and one(S.latin_only(F.lit("Arial")))
    assert one(S.word_box_font_size(F.array(F.struct(F.lit(10.0).alias("height"))), F.lit(5.0))) == 8.5
