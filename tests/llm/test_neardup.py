import random
import re
from collections import Counter

import numpy as np

from docweave.llm._vec import shingle_sets
from docweave.llm.components import components
from docweave.llm.neardup import near_duplicates, sketches


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    s = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s[i]), root(i)) for i in s}


def check(rows, frame):
    got = frame.collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_awkward_rows(docs_of, awkward):
    check(awkward, near_duplicates(docs_of(awkward)))


def test_empty(docs_of):
    assert near_duplicates(docs_of([])).count() == 0


def test_groups_of_near_copies_and_a_shared_passage(docs_of, words):
    rng = random.Random(3)
    base, passage = words(80, 2).split(), words(60, 9)
    rows = []
    for i in range(150):  # copies with few to many edits: many pairs lie about the threshold
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"{words(25, 100 + i)} {passage} {words(10, 900 + i)}") for i in range(80)]
    rows += [(2000 + i, "Exactly the same text in very many rows") for i in range(60)]
    check(rows, near_duplicates(docs_of(rows)))


def test_sketch_fills_and_estimates():
    text = [b"a", b"one two three four five six seven eight", b" ".join(b"%d" % i for i in range(900))]
    sets, bounds = shingle_sets(text, 5)
    assert (sketches(sets, bounds) != np.uint64(2**64 - 1)).all()
    a = np.arange(1, 2001, dtype=np.uint64) * np.uint64(7919)
    both = sketches(np.concatenate((a[:1500], a[500:])), np.array([0, 1500, 3000]))
    assert abs((both[0] == both[1]).mean() - 0.5) < 0.2


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (3, 4), (20, 30)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6, 8: 6, 9: 6, 20: 20, 30: 20}
    assert Counter(got.values())[1] == 4


def test_sql_form(spark, sf):
    import duckdb

    from docweave.llm.queries import NEAR_SQL, op3_minhash_near_dedup

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, op3_minhash_near_dedup(spark, sf).collect())) == sorted(c.sql(NEAR_SQL).fetchall())


def test_word_hashes_of_long_texts(words):
    from docweave.llm import _vec

    text = words(120_000, 5).encode()  # longer than several blocks, cut inside words but for care
    assert len(text) > 3 * _vec.BLOCK
    h, b = _vec.word_hashes([text])
    each = np.concatenate([_vec.word_hashes([w])[0] for w in text.split()[:2000]])
    assert b.tolist() == [0, 120_000] and (h[:2000] == each).all()
    h2, b2 = _vec.word_hashes([b"a b", text, b"", b"c"])
    assert b2.tolist() == [0, 2, 120_002, 120_002, 120_003] and (h2[2:-1] == h).all()
    assert _vec.word_hashes([b"x" * (2 * _vec.BLOCK)])[1].tolist() == [0, 1]
