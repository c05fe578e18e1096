"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

Distinct pre-tokens (words with a leading word mark) are inserted in a trie. The best
segmentation score of a prefix is worked out once, when its node is made, from the nodes
above it; a terminal node's token count is stored and looked up for every later
occurrence. Documents are read once, nothing is shuffled; trie and caches are bounded
and start anew when full, which changes no result.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._vec import batches, hash_spans, slices, spans

MARK = "▁"
NODES, WORDS = 400_000, 400_000
BYTE_SCORE = -25.0  #: of each byte of a character that no piece has


def unigram_vocabulary(path: str) -> dict[str, float]:
    """Pieces of a public sentencepiece model with Zipf scores: log of 1 / (rank * total)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class Trie:
    """Pre-tokens with forward scores and token counts at every node; node 0 is the root."""

    def __init__(self, vocabulary: dict[str, float]):
        self.back: dict = {}  # pieces, read from their end
        for p, s in vocabulary.items():
            at = self.back
            for c in reversed(p):
                at = at.setdefault(c, {})
            at[""] = s
        self.reset()

    def reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.up, self.sign, self.score, self.count = array("i", [0]), [""], array("d", [0.0]), array("i", [0])

    def _grow(self, parent: int, sign: str) -> int:
        node = len(self.up)
        self.up.append(parent)
        self.sign.append(sign)
        best, tokens = -math.inf, 0
        at, where = self.back, node
        while where and (at := at.get(self.sign[where])) is not None:
            where = self.up[where]
            if (s := at.get("")) is not None:
                v, n = self.score[where] + s, self.count[where] + 1
                if v > best or (v == best and n < tokens):
                    best, tokens = v, n
        if (at := self.back.get(sign)) is None or "" not in at:
            size = len(sign.encode("utf-8", "surrogatepass"))
            if (v := self.score[parent] + BYTE_SCORE * size) > best:
                best, tokens = v, self.count[parent] + size
        self.score.append(best)
        self.count.append(tokens)
        self.child[parent, sign] = node
        return node

    def tokens(self, word: str) -> int:
        """Tokens of the best segmentation (ties: fewest)."""
        node, get = 0, self.child.get
        for c in MARK + word:
            nxt = get((node, c))
            node = self._grow(node, c) if nxt is None else nxt
        return self.count[node]


_tries: dict[str, tuple[Trie, dict[int, int]]] = {}


def _count(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = _tries.get(path) or _tries.setdefault(path, (Trie(unigram_vocabulary(path)), {}))
        for batch in slices(it):
            texts = [(x or "").encode() for x in batch.column(0).to_pylist()]
            words, tokens = [], []
            for a, b in batches(texts, 2 << 20):
                raw = b"\n".join(texts[a:b]) + b"\n"
                buf = np.frombuffer(raw, np.uint8)
                starts, ends = spans(buf)
                uniq, first, inverse = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
                if len(known) > WORDS:
                    known.clear()
                if len(trie.up) > NODES:
                    trie.reset()
                n = np.array([known.get(h, -1) for h in uniq.tolist()], np.int64)
                for k in np.flatnonzero(n < 0).tolist():
                    n[k] = known[int(uniq[k])] = trie.tokens(raw[starts[first[k]] : ends[first[k]]].decode())
                total = np.concatenate(([0], np.cumsum(n[inverse])))
                bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts[a:b])]))
                words += np.diff(bounds).tolist()
                tokens += np.diff(total[bounds]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*batch.schema.names[1:], "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default) with n_pretokens and n_tokens.

    Pre-tokens are maximal runs of characters other than x20 and x09-x0D. Null or empty
    text: 0 and 0. Rows come out as often as they come in; columns of docs with the new
    names are replaced."""
    cols = [c for c in (docs.columns if keep is None else keep) if c not in ("n_pretokens", "n_tokens")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cols), "n_pretokens long, n_tokens long"])
    return docs.select(F.col(text_col).cast("string").alias("docweave_text"), *cols).mapInArrow(_count(model_path), schema)
