from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from docweave.llm.decontam import decontaminate
from docweave.llm.linededup import line_dedup
from docweave.llm.neardup import near_duplicates
from docweave.llm.packing import token_pieces
from docweave.llm.toxicity import toxicity_scores


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage of a run gives, on all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialise(stage(spark, out[-1], sf), "t"))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_do_as_their_operators(spark, sf, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "decontamination", "packing"]
    docs, clean, lines, single, apart, packed = stages
    for df in stages[:-1]:
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    labels, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("labels", "benchmark"))
    assert ids(clean) == ids(toxicity_scores(docs, labels).where("score < 0.7"))
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    assert text(lines) == text(line_dedup(clean)) and {r.doc_id: r.n_chars for r in lines.collect()} == {i: len(t) for i, t in text(lines).items()}
    groups = near_duplicates(lines).toPandas()
    assert ids(single) == set(groups[groups.kept].doc_id) and len(ids(single)) == groups.component_id.nunique()
    assert ids(apart) == ids(decontaminate(single, bench))
    pieces = token_pieces(apart, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    got = packed.toPandas()
    key = ["doc_id", "piece", "start", "length"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, pieces[key].values.tolist()))
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 2048


def test_run_leaves_no_tables_of_its_stages(spark, sf, stages):
    from docweave.llm import _common

    before = len(_common._written)
    packed = corpus_pipeline.run(spark, sf)
    assert packed.count() == stages[-1].count() and len(_common._written) == before + 1


def test_near_copies_leave_one(spark, docs_of):
    rows = [(i, "one and the same text in all of these rows") for i in (3, 1, 2, 1)] + [(None, "a"), (9, None)]
    got = corpus_pipeline.keep_one_of_each(spark, docs_of(rows), "")
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([1, None, 9], key=repr)


@pytest.mark.parametrize("extra", [["score", "n_dropped"], ["is_copy", "kept", "sequence_id"]])
def test_stages_with_awkward_rows(spark, sf, docs_of, awkward, extra):
    from pyspark.sql import functions as F

    docs = docs_of(awkward).drop("n_chars" if "score" in extra else "lang")
    for c in extra:
        docs = docs.withColumn(c, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.dtypes == docs.dtypes, name
        rows = Counter((r.doc_id, r.text) for r in got.collect())
        assert not rows - Counter(awkward) and all(set(r) >= {"mine"} for r in got.select(*extra).collect())
        # only near-dedup takes clean rows: one of each group of copies and repeated rows stays
        assert name == "minhash_near_dedup" or rows == Counter(awkward), name
        assert {(1, None), (2, ""), (3, " \n\t "), (4, "x"), (None, awkward[7][1])} <= set(rows)
        assert stage(spark, docs.limit(0), sf).count() == 0
    packed = corpus_pipeline.pack_sequences(spark, docs, sf)
    assert packed.where("piece = 0").count() == len(awkward) and corpus_pipeline.pack_sequences(spark, docs.limit(0), sf).count() == 0
