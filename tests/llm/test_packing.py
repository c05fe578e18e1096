import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from docweave.llm.packing import Encoder, pack, plan_packing, token_pieces

PATH = P.path("word_bpe_49k.json")


def test_encoder_gives_the_tokenizers_ids():
    texts = ["I've it's '' ''s !'s don't ... <|endoftext|> x<|startoftext|>y", "éà Ünï ß İstanbul naïve… a–b 1́ ≠ x", "日本語 текст ΣΑΣ ﬁ ½ ª º µ \x1c a\x1cb", "", " \n ", "a'llb 'Sx 12ab_3 z\x00 Hello, WORLD."]
    ids, bounds = Encoder(PATH)([t.encode() for t in texts])
    plain = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_round_trip(docs_of, awkward):
    got = pack(token_pieces(docs_of(awkward), PATH, capacity=64, keep_ids=True), 64).collect()
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in awkward:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want.update((i, k, s, tuple(ids[s : s + 64])) for k, s in enumerate(range(0, len(ids), 64)))
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64


def test_empty(docs_of):
    assert pack(token_pieces(docs_of([]), PATH)).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    lengths = np.clip(np.exp(rng.normal(6.3, 1, 4000)).astype(int), 1, 2048)
    h = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    plan = plan_packing(h)
    assert plan.used <= 1.005 * -(-lengths.sum() // 2048) + 1
    fill, seen = np.zeros(plan.used, int), Counter()
    for n, first, count, seq, per, _ in plan.runs:
        assert seen[n] == first
        seen[n] += count
        np.add.at(fill, seq + np.arange(count) // per, n)
    assert seen == Counter(h) and fill.max() <= 2048
