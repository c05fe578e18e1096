import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest

from docweave.llm import pii
from docweave.llm.langid import identify_language
from docweave.llm.pii import detect, find, find_pii, luhn
from docweave.llm.secrets import cutoffs, find_secrets
from docweave.llm.simhash import fingerprint_report, within_radius
from docweave.llm.tokencount import MARK, Trie, token_counts, unigram_vocabulary

MODEL = P.path("piece_bpe_32k.model")


def best(vocabulary, word):
    """Plain dynamic programme over one word: (score, tokens)."""
    s = MARK + word
    at = [(0.0, 0)]
    for i in range(1, len(s) + 1):
        options = [(at[j][0] + vocabulary[s[j:i]], -(at[j][1] + 1)) for j in range(i) if s[j:i] in vocabulary]
        if s[i - 1] not in vocabulary:
            n = len(s[i - 1].encode())
            options.append((at[i - 1][0] - 25.0 * n, -(at[i - 1][1] + n)))
        v, n = max(options)
        at.append((v, -n))
    return at[-1]


def test_trie_counts_match_a_plain_programme(docs_of, awkward):
    v = unigram_vocabulary(MODEL)
    trie = Trie(v)
    for w in ["a", "the", "therefore", "there", "internationalisation", "日本語", "😀x", "zzzzqqq", "été", "..."]:
        assert trie.tokens(w) == best(v, w)[1]
    rows = [r for r in awkward if len(r[1] or "") < 1000]
    got = sorted(((r.doc_id, r.n_pretokens, r.n_tokens) for r in token_counts(docs_of(rows), MODEL, keep=["doc_id"]).collect()), key=repr)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert got == sorted(((i, len(split(t)), sum(best(v, w)[1] for w in split(t))) for i, t in rows), key=repr)
    assert token_counts(docs_of([]), MODEL).count() == 0


def brute_pii(t):
    digits = lambda m: re.sub(r"\D", "", m[0])
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return [email, ip, card, phone]


def test_pii_base_matches_the_patterns():
    rng = random.Random(1)
    for _ in range(8000):
        t = "".join(rng.choice("ab1259@.+- ()") for _ in range(rng.randint(0, 60)))
        assert detect(t) == brute_pii(t), t


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("mail john.doe [at] example [dot] com now", 0, "john.doe [at] example [dot] com"),
    ("bob at mail dot example dot com!", 0, "bob at mail dot example dot com"),
    ("write ｊohn＠exаmple.com x", 0, "ｊohn＠exаmple.com"),
    ("ip 10 [dot] 0 [dot] 0 [dot] 1", 1, "10 [dot] 0 [dot] 0 [dot] 1"),
    ("call +1 five five five zero one two three four five ok", 3, "+1 five five five zero one two three four five"),
])
def test_pii_disguises_map_back(text, kind, span):
    base, every = find(text)
    assert not base[kind] and [text[a:b] for a, b in every[kind]] == [span]


@pytest.mark.parametrize("text", ["john at example.com", "john [at] example dot com", "john@example dot com", "john at example [dot] com", "john dot smith at example dot com", "john dot smith@example dot com"])
def test_pii_disguises_mix(text):
    assert pii.find(f"mail: {text}, today")[1][0] == [(6, 6 + len(text))]


def test_pii_rows(docs_of, awkward):
    rows = [*awkward, (20, "a@b.co and a@b.co 4111 1111 1111 1111 +1 (555) 555-1234 1.2.3.4")]
    got = find_pii(docs_of(rows), keep=["doc_id"]).collect()
    assert len(got) == len(rows)
    r = next(x for x in got if x.doc_id == 20)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added) == (2, 1, 1, 1, 0)
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert find_pii(docs_of([])).count() == 0
    assert pii.find("the at of it dot x")[1] == [[], [], [], []]


def brute_secrets(t):
    s = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    s += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    s += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(s))


def test_secrets(docs_of, awkward):
    rng = random.Random(4)
    parts = ["password=", "Token : '", "api_key", "AKIA", "ABCDEF123456", "0123456789abcdef" * 2, "zz", " ", "😀", "secret=token:", "=", "abcdefgh"]
    rows = [(100 + i, "".join(rng.choices(parts, k=rng.randint(0, 9)))) for i in range(120)]
    random64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=44))
    rows += [*awkward[:-3], awkward[-1], (900, f"key is {random64} there"), (901, "Donaudampfschifffahrtsgesellschaftskapitaenspatent internationalisations")]
    got = find_secrets(docs_of(rows), keep=["doc_id"]).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        want = brute_secrets(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    by = {r.doc_id: r for r in got}
    assert by[900].spans == f"random:7:{7 + len(random64)}" and by[901].n_added == 0
    assert find_secrets(docs_of([])).count() == 0


def test_cutoffs_are_benjamini_hochberg():
    counts = [(5, 0, 90), (5, 40, 5), (5, 15, 5)]
    assert cutoffs(counts, 0.01) == {5: 40}
    assert cutoffs([(4, 0, 10)], 0.01) == {4: 400}


def test_fingerprints(docs_of, awkward):
    rows = awkward + [(200, "a b c d e f g h"), (300, "a b c d e f g h")]
    got = fingerprint_report(docs_of(rows)).collect()
    assert len(got) == len(rows)
    order = sorted(((-(2**63) if i is None else i), t or "") for i, t in rows)
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        want.append((None if i == -(2**63) else i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    by = {r.doc_id: r for r in got}
    assert by[200].fingerprint == by[300].fingerprint and by[200].n_within >= 1 and by[5].n_within is None
    assert by[5].near_next == 1.0 and all(0 <= r.near_edited <= 1 for r in got)
    one = fingerprint_report(docs_of([(1, "one two three four")])).collect()[0]
    assert one.near_next == 1.0
    assert fingerprint_report(docs_of([])).count() == 0


def test_block_tables_find_all_within_radius(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    rows = [int(b) for b in base]
    for b in base:
        for flips in (1, 2, 3, 4):
            x = int(b) & (2**64 - 1)
            for bit in rng.choice(64, flips, replace=False):
                x ^= 1 << int(bit)
            rows.append(x - (1 << 64) if x >= 1 << 63 else x)
    e = spark.createDataFrame([(r, 1) for r in rows], "fp long, n int")
    got = {r.fp: r.near for r in within_radius(e.select("fp"), e, 3).collect()}
    for a in set(rows):
        assert got[a] == sum(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for b in rows)


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = identify_language(docs).selectExpr("lang", "lang_pred", "score").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_languages_of_awkward_rows(docs_of, awkward):
    got = {r.doc_id: r.lang_pred for r in identify_language(docs_of(awkward)).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[5] == "en"
    assert identify_language(docs_of([])).count() == 0
