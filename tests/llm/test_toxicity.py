import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm.toxicity import ALPHABET, SEPARATORS, STATES, Decoder, Scorer, _codes, char_model, features, fit, held_out, options, restore, skeleton, stretches, toxicity_scores

SPOKEN = "the idiot and you stupid loser were worthless trash to the moron you see " * 30


@pytest.fixture(scope="module")
def decode(spark):
    return Decoder(char_model(spark.createDataFrame([(1, SPOKEN), (2, None), (3, "")], "doc_id long, text string")))


@pytest.mark.parametrize(("seen", "meant"), [
    ("1d10t", "idiot"), ("st.u.p.id", "stupid"), ("l0ser", "loser"), ("m0r0n", "moron"), ("stuuupid", "stupid"), ("tr@sh", "trash"), ("stu" + "u" * 60 + "pid", "stupid"),
    (".".join("stupidmoron" * 5), "stupid moron"), ("w0rth.l3$$", "worthless"), ("$t_u_p_1_d", "stupid"), ("you-stupid-moron", "you stupid moron"),
    ("an i d i o t here", "idiot"), ("i   d   i   o   t", "idiot"), ("y o u s t u p i d m o r o n", "you stupid moron"), ("t r a s h\n\nl o s e r", "trash loser"), ("$ t u p 1 d", "stupid"), ("l os e r", "loser"),
])
def test_viterbi_restores_disguises(decode, seen, meant):
    assert set(meant.split()) <= restore(seen, decode)


def test_plain_text_is_as_it_is(decode):
    assert restore("It is, a well meant word. 12 34.5 (see) 2024-01-02!", decode) == {"it", "is", "a", "well", "meant", "word", "see"}


def every_reading(signs, lp):
    """All paths of a lattice: (score, reading)."""
    for path in itertools.product(*options(signs)):
        score, s = 0.0, 0
        for x, p in path:
            score += p
            if x:
                g = s * ALPHABET + int(_codes(x)[0])
                score, s = score + lp[g], g % STATES
        yield score + lp[s * ALPHABET], "".join(x for x, _ in path)


def test_viterbi_finds_the_best_of_all_readings(decode):
    rng = random.Random(3)
    for _ in range(150):
        signs = "".join(rng.choice("1!0$ -aolstiidé*\n") for _ in range(rng.randint(1, 7)))
        score, reading = decode.best(signs)
        readings = list(every_reading(signs, decode.lp))
        assert score == pytest.approx(max(readings)[0], abs=1e-9)
        assert any(r == reading and v == pytest.approx(score, abs=1e-9) for v, r in readings)


def test_every_reading_lies_in_the_skeleton(decode):
    rng = random.Random(4)
    for _ in range(150):
        signs = "".join(rng.choice("1!0$ -aolstiid*\n") for _ in range(rng.randint(1, 7)))
        whole = skeleton(signs)
        assert all(skeleton(w) in whole for _, r in every_reading(signs, decode.lp) for w in r.split()), signs


def test_scoring_without_decoding_what_cannot_count(decode):
    feats = ["=stupid", "=moron", "5worth", "4idio"]
    scorer = Scorer(np.array(decode.lp), feats, np.array([1.0, 2, 3, 4]), -3.0)
    texts = ["s t u p i d", "m0r0n here", "worthle$$ 1d10tic", "x9y8 a.b.c d-e-f", "st.u.p.id is as m o r o n does", "plain words only", ""]
    for t in texts:
        assert scorer.found(t) == {feats.index(f) for w in restore(t, decode) for f in features(w) if f in feats}, t


def test_runs_of_fragments():
    assert list(stretches("we see a b c then")) == ["a b c"]
    assert list(stretches("1 2 3 4 in of 5")) == ["1\n2 3\n4\nin\nof\n5"] or all("in" in s for s in stretches("1 2 3 4 in of 5"))
    assert list(stretches("1 2 3 4")) == [] and list(stretches("")) == [] and SEPARATORS


def test_logistic_weights_are_the_optimum():
    """Against plain Newton steps on the same loss."""
    rng = np.random.default_rng(5)
    n, k = 400, 6
    x = (rng.random((n, k)) < 0.2).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ np.array([3, 2, 1, 2, 0.5, 2.5]) - 2)))).astype(float)
    w, b = fit([np.flatnonzero(r).tolist() for r in x], y, k, rounds=3000, l2=0.0)
    a, v = np.hstack([x, np.ones((n, 1))]), np.zeros(k + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ v))
        v -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-9 * np.eye(k + 1), a.T @ (p - y))
    assert np.abs(np.append(w, b) - v).max() < 0.05
    assert fit([], np.zeros(0), 0)[1] < 0 and fit([[], []], np.ones(2), 0)[1] > 0


def test_toxicity(spark, docs_of, awkward, words):
    rows = [(i, words(12, i) + (" stupid moron" if i % 3 == 0 else "")) for i in range(10, 310)]
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i, _ in rows] + [(None, 0, 1), (10, 0, None)], "doc_id long, quality int, toxic int")
    test = rows + awkward + [(5001, words(8, 1) + " stup1d m0r0n"), (5002, words(8, 2) + " s t u p i d moron"), (5003, words(200_000, 3) + " stupid m.o.r.o.n"), (5004, "x1" * 100_000)]
    docs = docs_of(test).withColumn("docweave", F.lit(1))
    got = toxicity_scores(docs, labels).collect()
    assert got[0].__fields__ == [*(c for c in docs.columns if c != "score"), "score"]
    assert len(got) == len(test) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert all((by[i] >= 0.7) == (i % 3 == 0) for i, _ in rows)
    assert by[5001] >= 0.7 and by[5002] >= 0.7 and by[5003] >= 0.7 and by[1] < 0.7 and by[5004] < 0.7
    assert by[1] == by[2] == by[3]  # no evidence
    assert toxicity_scores(docs_of([]), labels).count() == 0
    assert toxicity_scores(docs_of(awkward), labels.limit(0)).count() == len(awkward)


def test_held_out_labels(spark, sf):
    at = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = toxicity_scores(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text"), labels).where(held_out()).join(labels, "doc_id").toPandas()
    toxic, flagged = got.toxic == 1, got.score >= 0.7
    # labels of the synthetic table are partly noise: no text of some toxic rows differs from the others
    assert flagged[toxic].mean() > 0.7 and flagged[~toxic].mean() < 0.02
