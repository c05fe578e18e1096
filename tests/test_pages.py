import json

import pytest
from pyspark.sql import functions as F

from docweave.functions import erase as E
from docweave.functions import geometry as G
from docweave.functions import prompts as P
from docweave.operators import blocks as B
from docweave.operators import quality as Q
from docweave.operators import recognised as R
from docweave.plans.stages import StageResult, results_table, run_stage
from docweave.sources import providers, structure


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def paragraph(spark, p):
    return spark.createDataFrame([(json.dumps(p),)], "j string").select(F.from_json("j", R.PARAGRAPH).alias("p"))


def test_padding_is_the_larger_of_margin_and_share(spark):
    b = G.Box(F.lit(100.0), F.lit(100.0), F.lit(100.0), F.lit(10.0))
    assert tuple(one(spark, G.pixel_rect(b, F.lit(400), F.lit(400), 12, 0.24, 0.30))) == (76, 88, 224, 122)


def test_paragraph_boxes(spark):
    line = {"text": "Hello world", "confidence": 1, "x": 10, "y": 20, "width": 100, "height": 16}
    own = {"text": "a b", "x": 0, "y": 0, "width": 50, "height": 10}
    got = [tuple(round(v, 3) for v in r) for r in paragraph(spark, own | {"lines": [line]}).select(R.paragraph_boxes(F.col("p"))).first()[0]]
    assert got == [(10, 20, 100, 16), (10, 20, 51.691, 16), (61.691, 20, 48.309, 16)]
    words = [{"text": "x", "x": 10, "y": 20, "width": 99, "height": 16}, {"text": "y", "x": 60, "y": 20, "width": 0, "height": 16}]
    assert len(paragraph(spark, own | {"lines": [line | {"words": words}]}).select(R.paragraph_boxes(F.col("p"))).first()[0]) == 1  # near its line's box
    assert len(paragraph(spark, own).select(R.paragraph_boxes(F.col("p"))).first()[0]) == 3
    assert paragraph(spark, {"text": "a", "width": 0}).select(R.paragraph_boxes(F.col("p"))).first()[0] == []


def test_full_lines(spark):
    got = paragraph(spark, {"text": "a b", "confidence": 0.5, "x": 1, "y": 2, "width": 3, "height": 4}).select(R.full_lines(F.col("p"))).first()[0]
    assert [(s.text, s.confidence, s.x, [w.text for w in s.words]) for s in got] == [("a b", 0.5, 1.0, ["a b"])]
    assert paragraph(spark, {"text": ""}).select(R.full_lines(F.col("p"))).first()[0] == []


@pytest.mark.parametrize(("block", "text"), [
    ({"text": " ", "content": "c"}, "c"), ({"res": {"html": "<b>"}}, "<b>"), ({"res": [{"text": "a"}, "b", {"text": "", "content": "c"}, {}]}, "a b c"), ({"rec_text": "r"}, "r"), ({}, "")])
def test_block_text(spark, block, text):
    assert one(spark, structure.block_text(F.lit(json.dumps(block)))) == text


@pytest.mark.parametrize(("block", "rows"), [
    ({"res": {"cells": [{"row": 0, "col": 1, "text": "b"}, {"row_idx": 1, "col_idx": 0, "content": "c"}, {"row": 0, "col": 1, "text": "late"}]}}, [["", "b"], ["c", ""]]),
    ({"res": "<table><TR><td>a</td><td> <i>b</i></td></TR></table>"}, [["a", "b"]]), ({"html": "<tr><th>h</th></tr>"}, [["h"]]), ({"text": "x\n \ny"}, [["x"], ["y"]]), ({"res": {}}, None)])
def test_table_rows(spark, block, rows):
    assert one(spark, structure.table_rows(F.lit(json.dumps(block)))) == rows


def test_structure(spark):
    page = {"res": "none", "blocks": [{"label": "Table", "bbox": [1, 2, 3, 4], "text": "t"}, "x", {"type": "figure", "box": {"x1": 5, "y1": -1, "x2": 9, "y2": 9}, "text": "", "score": 0.5}, {"text": "p", "bbox": [0, 0, 700, 9]}, {"text": "no box"}]}
    pages = spark.createDataFrame([(1, json.dumps(page)), (2, None), (3, "{"), (4, '{"bbox": [1, 1, 2, 2], "text": "alone"}')], "id int, content string")
    found = structure.structure(pages, "content", F.lit(600.0), F.lit(800.0))
    regions, paragraphs, tables = structure.split_structure(found)
    assert sorted(tuple(r) for r in regions.collect()) == [(1, 0, "table", 1, 2, 3, 4, 0.9), (1, 1, "figure", 5, 0, 4, 10, 0.5), (1, 2, "paragraph", 0, 0, 700, 9, 0.9), (4, 0, "paragraph", 1, 1, 2, 2, 0.9)]
    assert sorted((r.id, r.text, r.confidence) for r in paragraphs.collect()) == [(1, "p", 0.85), (4, "alone", 0.85)]
    assert [(r.id, r.rows) for r in tables.collect()] == [(1, [["t"]])]


def test_prompts(spark):
    terms = F.expr("transform(sequence(1, 25), i -> named_struct('term', concat('t', i), 'translation', 'x'))")
    hint = one(spark, P.term_hint(terms))
    assert '"t20" → "x"' in hint and "t21" not in hint and one(spark, P.term_hint(F.slice(terms, 1, 0))) == ""
    system = one(spark, P.batch_system(F.lit("EN"), F.lit("xx"), F.lit(3), terms))
    assert "all 3 items from English into xx" in system and '"t25" → "x"' in system
    assert "Terms" not in one(spark, P.single_system(F.lit("en"), F.lit("fr"), F.slice(terms, 1, 0)))
    assert one(spark, P.single_user(F.lit("footer"), F.lit("in 2024"))).endswith("__KEEP_0__") and "Hint" not in one(spark, P.single_user(F.lit("paragraph"), F.lit("x")))
    item = P.batch_item(F.lit(0), F.lit("paragraph"), F.lit("x"), F.lit(None).cast("int"), F.lit("p" * 200), F.lit(None).cast("string"))
    assert json.loads(one(spark, P.batch_user(F.array(item)))) == {"items": [{"id": 0, "type": "paragraph", "text": "x", "prev": "p" * 120}]}
    assert [one(spark, P.model_installed(F.lit(m), F.array(F.lit("a:b"), F.lit("c")))) for m in ("a", "c", "b", "")] == [True, True, False, False]


def test_qa_sample_falls_back_to_the_first_three(spark):
    b = spark.range(60).selectExpr("if(id < 4, 1, 2) doc_id", "id")
    got = B.qa_sample(b, ["id"], "id", share=0.0).collect()
    assert sorted((r.doc_id, r.id) for r in got) == [(1, 0), (1, 1), (1, 2), (2, 4), (2, 5), (2, 6)]
    some = B.qa_sample(b, ["id"], "id", share=0.5).collect()
    assert 15 < len(some) < 45 and some == B.qa_sample(b, ["id"], "id", share=0.5).collect()


def test_stages(spark):
    good, bad = run_stage("a", lambda: 5, provider="p"), run_stage("b", lambda: 1 / 0)
    assert good.success and good.data == 5 and not good.fatal and bad.fatal and not bad.success and "division" in bad.errors[0][1]
    soft = StageResult("c").fail("late", fatal=False)
    assert not soft.fatal and not soft.success and soft.ok(3).success
    assert [(r.stage, r.success, r.fatal, r.errors) for r in results_table(spark, [good, soft]).collect()] == [("a", True, False, []), ("c", False, False, ["late"])]


def test_timings_and_warnings_add_up(spark):
    m = Q.add_timings(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(4.0)))
    assert one(spark, m) == {"a": 3.0, "b": 4.0}
    assert one(spark, Q.more_warnings(F.lit(None).cast("array<string>"), F.array(F.lit("x")), F.lit(None).cast("array<string>"))) == ["x"]


def test_store(spark, tmp_path):
    store = providers.Store(spark, f"file://{tmp_path}")
    store.save_documents(spark.createDataFrame([("b", "n"), ("a", "m")], "id string, name string"))
    assert [r.id for r in store.document_ids().collect()] == ["a", "b"]
    store.save_settings({"dpi": 150})
    assert store.settings("dpi int, model string", {"dpi": 300, "model": "m"}) == {"dpi": 150, "model": "m"}
    store.save_glossary(spark.createDataFrame([("t", "u")], "term string, translation string"))
    from docweave.sources.store import read_glossary

    assert [tuple(r) for r in read_glossary(spark, f"file://{tmp_path}/glossary").collect()] == [("t", "u")]


def test_cache(spark, tmp_path):
    from docweave.sources.ingest import write_cache

    path, kind = f"file://{tmp_path}/cache", "struct<a:int>"
    assert providers.read_cache(spark, path, kind, "ocr").count() == 0
    write_cache(spark.createDataFrame([(1, 1, "h", '{"a": 1}', "ocr"), (1, 2, "h", None, "ocr"), (1, 1, "h", '{"a": 2}', "layout")], "doc_id long, page_number int, hash string, value string, stage string"), path)
    assert [(r.page_number, r.value.a) for r in providers.read_cache(spark, path, kind, "ocr").collect()] == [(1, 1)]


def test_export_of_an_unknown_format(spark):
    with pytest.raises(ValueError, match="html"):
        providers.export(spark.range(1), "docx")
    assert providers.vision("other").name == "heuristic"


def test_empty_tables_have_no_rects(spark):
    rows = F.array().cast("array<array<string>>")
    b = G.Box(*(F.lit(v) for v in (0, 0, 9, 9)))
    cells = F.array().cast("array<struct<x:double,y:double,width:double,height:double,font_size:double>>")
    assert one(spark, E.table_rects(cells, rows, b, F.lit(9), F.lit(9))) == [] and one(spark, E.cell_rects(cells, rows, b, F.lit(9), F.lit(9))) == []
    assert one(spark, E.span_box(F.array(F.lit(1.0)))) is None
