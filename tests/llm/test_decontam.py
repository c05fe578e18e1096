import random
import re
from collections import defaultdict

import pytest

from docweave.llm.decontam import UNITS, contaminated, contamination_report, decontaminate

QUESTION = "A train leaves the old station with 120 passengers and travels 45 km before Anna counts 17 empty seats near the window"
ITEM = "item_id long, text string"


def flagged(spark, docs_of, items, rows):
    got = contamination_report(docs_of(rows), spark.createDataFrame(items, ITEM)).where("contaminated").collect()
    return {r.doc_id: r.item_id for r in got}


def test_templates(spark, docs_of, words):
    bench = [(1, QUESTION), (2, words(30, "b")), (3, "only three words"), (4, None), (5, "")]
    filler = lambda k: words(20, f"f{k}") + ". "
    rows = [
        (1, filler(1) + QUESTION + " " + filler(2)),
        (2, filler(3) + QUESTION.replace("120", "98").replace("45", "7,5").replace("17", "31").replace("Anna", "Boris") + " end"),
        (3, filler(4) + " " + filler(5)),
        (4, filler(6) + words(30, "b") + filler(7)),
        (5, "Only three WORDS!"),
        (6, filler(8) + " ".join(QUESTION.split()[:7])),
        (7, filler(9) + "only three words " + filler(10)),
    ]
    assert flagged(spark, docs_of, bench, rows) == {1: 1, 2: 1, 4: 2, 5: 3}
    docs = docs_of(rows)
    assert {r.doc_id for r in decontaminate(docs, spark.createDataFrame(bench, ITEM)).collect()} == {3, 6, 7}


def test_short_items_are_found_inside_documents(spark, docs_of, words):
    bench = [(1, "What is the capital of France?"), (2, "12 + 7 - 30 * 4 = 99"), (3, "who wrote that book")]
    filler = lambda k: words(20, f"s{k}")
    rows = [(1, f"{filler(1)} What is the capital of France? {filler(2)}"), (2, f"{filler(3)}. What is the capital of Norway? {filler(4)}"), (3, f"{filler(5)} 12 + 7 - 30 * 4 = 99 {filler(6)}"),
            (4, f"{filler(7)} 12 + 8 - 30 * 4 = 99 {filler(8)}"), (5, f"{filler(9)} who wrote that book {filler(10)}"), (6, f"{filler(11)} who wrote that {filler(12)}"), (7, f"{filler(1)} {filler(12)}")]
    assert flagged(spark, docs_of, bench, rows) == {1: 1, 2: 1, 3: 2, 5: 3}


def test_slots_must_map_one_to_one(spark, docs_of):
    # the item repeats one value in three places; a text with three different values is another one
    item = "put 5 red balls in the large box then put 5 blue balls in the small box then put 5 green balls in the last box"
    rows = [(1, item.replace("5", "8")), (2, item.replace("5", "8", 1).replace("5", "9", 1))]
    assert flagged(spark, docs_of, [(1, item)], rows) == {1: 1}


def test_slots_are_compared_within_an_occurrence(spark, docs_of, words):
    cups = "Add 3 cups of sugar to the bowl slowly. Add 4 cups of sugar to the bowl slowly."
    variant = QUESTION.replace("120", "98")
    rows = [(1, f"{QUESTION} {words(9, 'z')}. {variant}"), (2, f"{words(9, 'y')}. {cups}"), (3, words(40, "x")), (4, f"{variant} {words(9, 'v')}. {QUESTION}"),
            (5, f"{QUESTION} {words(9, 'z')}. {variant.replace('45', '120')} " + variant.replace("travels", "then travels"))]
    assert flagged(spark, docs_of, [(1, QUESTION), (2, cups)], rows) == {1: 1, 2: 2, 4: 1, 5: 1}


def plain(text):
    """(value, shape, is slot, is name) of the words, by the rules as written."""
    out, fresh, number = [], True, False
    for line in (text or "").split("\n"):
        fresh = True
        for w in line.split():
            core = re.sub(r"^[^A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff]+$", "", w) or w
            v = core.lower()
            is_number = bool(re.fullmatch(r"[0-9.,:/%-]*[0-9][0-9.,:/%-]*", core))
            unit = number and v in UNITS
            name = bool(re.fullmatch(r"[A-Z][^A-Z]*", core)) and not fresh and not unit
            out.append((v, "#" if is_number else "unit" if unit else "name" if name else v, is_number or unit, name))
            fresh, number = w[-1] in ".!?:;", is_number
    return out


def windows(ws, size):
    for p in range(len(ws) - size + 1):
        w = ws[p : p + size]
        first = (w[0][0], w[0][0], False, False) if w[0][3] else w[0]
        w = [first, *w[1:]]
        if sum(not (x[2] or x[3]) and any(c.isalnum() for c in x[0]) for x in w) >= 4:
            yield p, (size, tuple(x[1] for x in w)), tuple(x[0] for x in w if x[2] or x[3])
        else:
            yield p, (size, "verbatim", *(x[0] for x in w)), ()


def brute(docs, items, k=8):
    out = set()
    for item, text in items:
        ws = plain(text)
        if not ws:
            continue
        size = min(k, len(ws))
        if size < 4:
            out |= {i for i, t in docs if [x[0] for x in plain(t)] == [x[0] for x in ws]}
            continue
        at = defaultdict(dict)
        for p, h, slots in windows(ws, size):
            at[h].setdefault(slots, p)
        for i, t in docs:
            hits = [(p - q, h, s, z) for p, h, z in windows(plain(t), size) for s, q in at.get(h, {}).items()]
            groups, last, n = defaultdict(list), None, 0
            for x in sorted(hits, key=lambda x: x[0]):
                n += last is not None and x[0] - last > 2 + (len(at) + k - 1) / 10
                last = x[0]
                for g in ("all", ("shift", x[0]), ("near", n)):
                    groups[g].append(x)
            for g in groups.values():
                pairs = {p for _, _, s, z in g for p in zip(s, z)}
                matched = len({h for _, h, _, _ in g})
                if len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and (matched >= 6 or matched >= 0.5 * len(at)):
                    out.add(i)
    return out


def test_against_a_plain_matcher(spark, docs_of):
    rng = random.Random(11)
    vocab = ["put", "ball", "in", "box", "then", "Anna", "Boris", "5", "8", "km", "red.", "the", "(big)", "ran\n", "+"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([2, 3, 4, 5, 7, 8, 9, 12, 20]))) for i in range(40)]
    docs = [(i, say(rng.randint(0, 25))) for i in range(100)]
    for i in range(100, 260):  # copies, some with other values, some twice
        t = rng.choice(items)[1]
        for a, b in (("5", "8"), ("Anna", "Boris")):
            t = t.replace(a, b) if rng.random() < 0.4 else t
        docs.append((i, " ".join([say(rng.randint(0, 9)), t, say(rng.randint(0, 9)), *([rng.choice(items)[1]] if rng.random() < 0.4 else [])])))
    assert set(flagged(spark, docs_of, items, docs)) == brute(docs, items)


def test_decontamination_of_awkward_rows(spark, docs_of, awkward, words):
    bench = spark.createDataFrame([(1, "same words here again and again"), (1, "same words here again and again"), (None, "no id but a text")], ITEM)
    docs = docs_of(awkward)
    assert decontaminate(docs, bench).count() == len(awkward) - 3
    assert decontaminate(docs, bench.limit(0)).count() == len(awkward)
    assert contaminated(docs_of([]), bench).count() == 0
    assert decontaminate(docs, bench).columns == docs.columns
    # ties in coverage go to the smallest id; an item across the parts of a very long text is found
    long = words(300_000, "long")
    item = " ".join(long.split()[113_000:113_900])
    got = contamination_report(docs_of([(1, long), (2, "x y")]), spark.createDataFrame([(9, item), (3, item)], ITEM)).collect()
    assert {(r.doc_id, r.item_id, r.n_items) for r in got} == {(1, 3, 2), (2, None, 0)}


@pytest.mark.parametrize("size", [4, 64, 1000])
def test_scanning_in_parts(monkeypatch, size):
    from docweave.llm import _vec

    rng = random.Random(size)
    raw = "".join(rng.choice("ab1. \nÉX,") for _ in range(3000)).encode()
    whole = _vec.scan(raw, bare=True)
    parts = _vec._parts
    monkeypatch.setattr(_vec, "_parts", lambda t, s=size: parts(t, size))
    assert all((a == b).all() for a, b in zip(whole, _vec.scan(raw, bare=True)))
