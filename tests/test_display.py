import pytest
from pyspark.sql import functions as F

from docweave.functions import style as S
from docweave.operators import assembly, display


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_texts(spark):
    assert one(spark, display.status_text(F.lit("layout_detection"))) == "Layout Detection"
    assert [one(spark, display.byte_text(F.lit(n))) for n in (12, 1280, 3 << 20)] == ["12 B", "1.3 KB", "3.0 MB"]
    assert one(spark, display.shown_confidence(F.lit(None).cast("double"), F.lit(None).cast("double"))) == "—"
    w = F.array(F.lit("Translation FAILED"), F.lit("late"), F.lit("engine not installed"))
    assert one(spark, display.failures(w)) == ["Translation FAILED", "engine not installed"] and one(spark, display.other_warnings(w)) == ["late"]


@pytest.mark.parametrize(("v", "want"), [([1.0, 0.5, 0.0], "#ff7f00"), ([255.0, 16.0, 2.0], "#ff1002"), ([1.0], "#000000"), (None, "#000000")])
def test_colours(spark, v, want):
    c = F.lit(None).cast("array<double>") if v is None else F.array(*map(F.lit, v))
    assert one(spark, S.color_triple(c)) == want


def test_fonts(spark):
    assert one(spark, S.arabic_capable(F.lit("Arial Unicode MS"))) and not one(spark, S.latin_only(F.lit("Arial Unicode MS")))
    assert one(spark, S.needs_arabic(F.lit("abc"), F.lit("ltr"), F.lit("fa"))) and not one(spark, S.needs_arabic(F.lit("abc"), F.lit(None).cast("string"), F.lit("en")))


def test_lines_and_paragraphs(spark):
    d = spark.createDataFrame([(1, 1, 50.0, 10.0, 20.0, 8.0, " b ", 0.5), (1, 1, 10.0, 11.0, 30.0, 9.0, "a", 1.0), (1, 2, 10.0, 30.0, 5.0, 5.0, " ", 0.25)], "p int, line int, x double, y double, width double, height double, text string, confidence double")
    lines = assembly.build_lines(d, ["p", "line"], ["x"])
    assert [tuple(r) for r in lines.orderBy("line").collect()] == [(1, 1, "a b", 0.75, 10.0, 10.0, 60.0, 10.0), (1, 2, "", 0.25, 10.0, 30.0, 5.0, 5.0)]
    assert tuple(assembly.build_paragraphs(lines, ["p"], ["line"]).first()) == (1, "a b", 0.5, 2, 10.0, 10.0, 60.0, 25.0)
    assert one(spark, assembly.running_offsets(F.array(F.lit(1.0), F.lit(2.5)))) == [0.0, 1.0, 3.5]
