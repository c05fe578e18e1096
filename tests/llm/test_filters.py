import random
from collections import Counter, defaultdict

import pyspark.sql.functions as F

from docweave.llm.linededup import line_dedup


def test_recurring_passages_go_and_copies_stay(docs_of, words):
    passage = ". ".join(words(12, f"p{i}") for i in range(5)) + "."
    own = {i: ". ".join(words(11, f"{i}/{k}") for k in range(14)) + "." for i in range(40)}
    rows = [(i, f"{t[:300]}. {passage} {t[300:]}" if i < 10 else t) for i, t in own.items()]
    rows += [(100 + i, f"{own[20 + i]}\nOrder {i}{i} shipped to the usual place on the day") for i in range(6)]
    copy = ". ".join(words(10, f"c{k}") for k in range(9)) + "."
    rows += [(200 + i, copy) for i in range(8)]
    got = {r.doc_id: r for r in line_dedup(docs_of(rows)).collect()}
    inner = ". ".join(words(12, f"p{i}") for i in range(1, 4))
    for i in range(10):
        assert inner not in got[i].text and words(11, f"{i}/12") in got[i].text and not got[i].is_copy
    for i in range(30, 40):
        assert got[i].text == own[i] and got[i].n_dropped == 0
    for i in range(6):
        assert "shipped" not in got[100 + i].text
    for i in range(8):
        assert got[200 + i].text == copy and got[200 + i].is_copy


def test_headers_and_footers_go_at_the_edge_of_documents(docs_of, words):
    line = words(9, "h") + ". Eriner thanea."
    own = {i: [words(11, f"e{i}/{k}") + "." for k in range(4)] for i in range(60)}
    rows = [(i, "\n".join([line, *t] if i < 20 else [*t, line] if i < 40 else [*t[:2], line, *t[2:]])) for i, t in own.items()]
    for r in line_dedup(docs_of(rows)).collect():
        assert r.n_dropped == 2 and "Eriner" not in r.text and words(9, "h") not in r.text, r.doc_id
        assert all(k in r.text for k in own[r.doc_id])


def test_copies_that_hold_a_passage_do_not_keep_it_elsewhere(docs_of, words):
    passage = " ".join(words(12, f"q{i}") + "." for i in range(3))
    own = {i: [words(11, f"g{i}/{k}") + "." for k in range(4)] for i in range(71)}
    text = lambda t: " ".join([*t[:2], passage, *t[2:]])
    rows = [(i, text(own[i])) for i in range(40)] + [(100 + i, text(own[70])) for i in range(30)]
    rows += [(200 + i, text([own[70][0], own[50 + i][0], *own[70][2:]])) for i in range(5)]  # edited beside it
    got = {r.doc_id: r for r in line_dedup(docs_of(rows)).collect()}
    assert all(got[i].n_dropped == 3 and words(12, "q1") not in got[i].text for i in range(40))
    # most documents of the passage are no copies of each other: it goes from the copies too, their own lines stay
    assert all(r.n_dropped == 3 and r.is_copy and words(11, "g70/0") in r.text for i, r in got.items() if i >= 100)
    few = {r.doc_id: r for r in line_dedup(docs_of(rows[30:])).collect()}
    assert all(few[i].n_dropped == 3 for i in range(30, 40)) and all(r.n_dropped == 0 and r.is_copy for i, r in few.items() if i >= 100)


def test_headers_before_short_lines_go(docs_of, words):
    head = "This page was printed from our public site today\nMenu\n"
    for n in (3, 9, 30):
        rows = [(i, head + words(n, f"b{n}/{i}")) for i in range(12)]
        for r in line_dedup(docs_of(rows)).collect():
            assert r.text == words(n, f"b{n}/{r.doc_id}") and r.n_dropped == 2 and not r.is_copy


def test_edited_copies_keep_their_lines(docs_of, words):
    rng = random.Random(8)
    base = [words(12, f"k{k}") for k in range(30)]
    rows = []
    for i in range(40):  # every twelfth word or so is another; a block of three lines is another in some
        t = [" ".join(w if rng.random() > 0.02 else words(1, rng.random()) for w in x.split()) for x in base]
        if i % 8 == 0:
            t[9:12] = [words(12, f"n{i}/{k}") for k in range(3)]
        rows.append((i, ".\n".join(t) + "."))
    rows += [(100 + i, ".\n".join(words(12, f"o{i}/{k}") for k in range(8))) for i in range(20)]
    texts = dict(rows)
    for r in line_dedup(docs_of(rows)).collect():
        assert r.text == texts[r.doc_id] and (r.is_copy == (r.doc_id < 100) or r.doc_id % 8 == 0)


def plain_dedup(docs, min_docs=4, depth=3):
    """The rules as written, for documents of lines of five tokens or more without points."""
    wild = lambda w: "*" if any(c in "0123456789" for c in w) else w
    texts = {i: [tuple(map(wild, x.split())) for x in t.split("\n")] for i, t in docs}
    leaf = lambda x: (len(x), *x[:depth])
    held = defaultdict(set)
    for i, t in texts.items():
        for x in t:
            held[x].add(i)
    n = {x: len(d) for x, d in held.items()}
    at = Counter()
    for x in n:
        for p, w in enumerate(x):
            at[leaf(x), p, w] += n[x]
    of = {}
    for x in n:
        common = {(p, w): at[leaf(x), p, w] for p, w in enumerate(x) if w != "*" and at[leaf(x), p, w] >= min_docs}
        of[x] = set()
        level = min_docs
        while common and level <= max(common.values()):
            c = frozenset(k for k, d in common.items() if d >= level)
            if len(c) >= max(4, 0.7 * len(x)):
                of[x].add((leaf(x), c))
            level *= 4
    full = lambda x: frozenset((p, w) for p, w in enumerate(x) if w != "*")
    for x in n:
        of[x] |= {(leaf(x), full(x) - {k}) for k in full(x)} if n[x] >= min_docs else set()
    lines = defaultdict(set)
    for x, ts in of.items():
        for t in ts:
            lines[t].add(x)
    good = {t for t, xs in lines.items() if max(n[x] for x in xs) >= min_docs or len(set().union(*(held[x] for x in xs))) >= min_docs}
    return texts, {x for x in n if n[x] >= min_docs or of[x] & good}


def test_against_a_plain_template_miner(spark, docs_of):
    """Which lines recur: those that the operator counts (of documents that are no copies) are those of the plain miner."""
    rng = random.Random(21)
    vocab = "ka lo mi ter son ver alt rum pel dis gor han".split()
    fixed = [[rng.choice(vocab) for _ in range(rng.randint(6, 11))] for _ in range(14)]

    def line():
        if rng.random() < 0.55:
            x = list(rng.choice(fixed))
            for _ in range(rng.choice([0, 0, 1, 2])):
                x[rng.randrange(len(x))] = rng.choice(["17", "x1", "ka", f"q{rng.choice('abcdefgh')}z"])
            return " ".join(x)
        return " ".join(f"u{''.join(rng.choices('abcdefghij', k=6))}" for _ in range(rng.randint(5, 9)))

    docs = [(i, "\n".join(line() for _ in range(rng.randint(2, 9))) + "\n" + " ".join(f"w{''.join(rng.choices('abcdefghij', k=7))}" for _ in range(60))) for i in range(120)]
    texts, recurring = plain_dedup(docs)
    got = {r.doc_id: r for r in line_dedup(docs_of(docs)).collect()}
    for i, t in docs:
        kept = [x for x, toks in zip(t.split("\n"), texts[i]) if toks not in recurring]
        assert got[i].text.split() == " ".join(kept).split() and not got[i].is_copy, i


def test_very_long_texts(docs_of, words):
    head = "This line stands at the top of every one of these pages"
    long = "\n".join(words(12, f"L{k}") for k in range(20_000))
    rows = [(0, head + "\n" + long), *((i, head + "\n" + words(40, f"s{i}")) for i in range(1, 6)), (9, "one " * 500_000)]
    got = {r.doc_id: r.text for r in line_dedup(docs_of(rows)).collect()}
    assert got[0] == long and got[9] == "one " * 500_000 and all(got[i] == words(40, f"s{i}") for i in range(1, 6))


def test_common_values_of_a_field_are_no_constants(docs_of, words):
    cities = [words(1, f"city{i}") for i in range(12)]
    body = lambda i: words(11, f"v{i}") + ".\n"
    rows = [(12 * i + j, f"{body((i, j))}Your parcel was sent from {a} to {b} on Monday morning\n{body((j, i, 1))}") for i, a in enumerate(cities) for j, b in enumerate(cities)]
    # a rare variant of a frequent line goes with it
    seen = lambda x: f"We would like to thank our {x} readers for the kind letters"
    rows += [(300 + i, f"{body((i, 2))}{seen('many' if i < 30 else 'old')}\n{body((i, 3))}") for i in range(31)]
    for r in line_dedup(docs_of(rows)).collect():
        assert r.n_dropped == 1 and "parcel" not in r.text and "readers" not in r.text, r.text


def test_short_lines_are_counted(docs_of, words):
    own = {i: [words(11, f"s{i}/{k}") + "." for k in range(4)] for i in range(12)}
    rows = [(i, "\n".join([*t[:2], f"{i}", "Share this. Print.", *t[2:], "All rights reserved."])) for i, t in own.items()]
    for r in line_dedup(docs_of(rows)).collect():
        t = own[r.doc_id]
        assert r.text.split("\n")[:5] == [*t[:2], f"{r.doc_id}", *t[2:]] and "reserved" not in r.text and r.n_dropped == 3


def test_line_dedup_of_awkward_rows(docs_of, awkward):
    docs = docs_of(awkward).withColumn("drops", F.lit(1)).withColumn("n_dropped", F.lit("x"))
    got = line_dedup(docs)
    assert got.columns == [*(c for c in docs.columns if c != "n_dropped"), "n_dropped", "is_copy"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(awkward)
    assert line_dedup(docs_of([])).count() == 0
