"""Toxicity by noisy-channel deobfuscation.

A character 4-gram model is counted over all documents. What looks disguised becomes a
lattice: a token with digits or symbols among letters, separators inside a word or letters
repeated, and a run of three or more fragments (tokens of one or two letters: letters spaced
out, however wide). Every sign of the lattice may be what it stands for, may be left out, or
may be a word boundary, blanks too; Viterbi decoding finds the likeliest words under channel and
model, in time linear in the lattice, of any length. A logistic model over words and word
beginnings, of the text as restored, scores it.

Scale: two passes over the texts. The model table is bounded by its alphabet; the
classifier is fitted on about fit_rows labelled rows, whose features are counted on the
executors, so that only those that go with the label reach the driver. In scoring, a lattice
that can spell no scored feature by any path is not decoded: its skeleton (signs that may
stand for the same letter as one, separators off, repetitions once) holds none of theirs.
"""

from __future__ import annotations

import array
import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise
from ._vec import slices

ALPHABET = 28  #: 0: not a letter, 1-26: a-z, 27: any other letter
ORDER = 4
STATES = ALPHABET ** (ORDER - 1)
CACHE = 50_000
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "¡": "i", "£": "l"}
SEPARATORS = set(".-_*~'/\\^`·•")
NARROW, WIDE = " ", "\n"  #: blanks of a lattice: as between spaced letters, or as between words
_CLASS = np.array([ord(chr(i).lower()) - 96 if i < 128 and chr(i).isalpha() else 27 if chr(i).isalpha() else 0 for i in range(0x10000)], np.uint8)
_WORD = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"(.)\1\1")
_REPEATED = re.compile(r"(.)\1+", re.S)
_LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
_SHORT_TOKENS = re.compile(r"(?<!\S)\S{1,3}(?:\s+\S{1,3}(?!\S)){2,}")
_BLANKS = re.compile(r"(\s+)")


def _codes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(cp, 0xFFFF)]


def _grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ALPHABET**ORDER, np.int64)
    for batch in slices(it):
        for k in range(0, batch.num_rows, 500):
            text = "\n\n\n".join(["", *(x or "" for x in batch.column(0)[k : k + 500].to_pylist()), ""])
            for a in range(0, len(text), 1 << 22):
                c = _codes(text[a : a + (1 << 22) + ORDER - 1]).astype(np.int32)
                if len(c) >= ORDER:
                    g = c[: len(c) - 3] * 28
                    g += c[1:-2]
                    g *= 28
                    g += c[2:-1]
                    g *= 28
                    g += c[3:]
                    total += np.bincount(g, minlength=len(total))
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["gram", "n"])


def char_model(docs: DataFrame) -> np.ndarray:
    """log P(last sign | three before), for all 28**4 grams, from all texts of docs."""
    counts = docs.select(F.col("text").cast("string")).mapInArrow(_grams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most 28**4 rows
    table = np.zeros(ALPHABET**ORDER)
    table[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    n4 = table.reshape((ALPHABET,) * ORDER)
    low = np.full(ALPHABET, 1 / ALPHABET)
    for n in (n4.sum((0, 1, 2)), n4.sum((0, 1)), n4.sum(0), n4):  # each order backs off to the one below
        low = (n + 5 * low) / (n.sum(-1, keepdims=True) + 5)
    return np.log(low).astype(np.float32)


def options(signs: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each sign what it can be and the channel's log probability. "" is
    nothing, a blank is a word boundary. Signs of LEET are left out only where they repeat."""
    out = []
    for i, c in enumerate(signs):
        again = i > 0 and signs[i - 1] == c
        if c == NARROW:
            o = [("", -0.4), (" ", -1.1)]
        elif c == WIDE:
            o = [(" ", -0.05), ("", -3.0)]
        elif c.isalpha():
            o = [(c, -0.05)]
            if again:
                o.append(("", -0.7 if i < 2 or signs[i - 2] != c else -0.05))
        elif c in LEET:
            o = [*((x, -1.0) for x in LEET[c]), (" ", -3.0)]
            if again:
                o.append(("", -0.7))
        else:
            o = [("", -0.7), (" ", -1.2)] if c in SEPARATORS else [(" ", -0.7), ("", -4.0)]
        out.append(o)
    return out


class Decoder:
    """Viterbi over a lattice; a state is the last three signs, as one number."""

    def __init__(self, model: np.ndarray):
        self.lp = array.array("f", np.ascontiguousarray(model, np.float32).tobytes())
        self.known: dict[str, tuple[str, ...]] = {}

    def best(self, signs: str) -> tuple[float, str]:
        """The likeliest reading, with its log probability."""
        lp = self.lp
        states: dict[int, tuple] = {0: (0.0, None)}
        for o in options(signs):
            steps = [(x, int(_CLASS[min(ord(x), 0xFFFF)]), p) for x, p in o if x]
            skip = max((p for x, p in o if not x), default=None)
            after: dict[int, tuple] = {}
            for s, (v, path) in states.items():
                for x, k, p in steps:
                    g = s * ALPHABET + k
                    w = v + p + lp[g]
                    t = g % STATES
                    got = after.get(t)
                    if got is None or w > got[0]:
                        after[t] = (w, (path, x))
                if skip is not None:
                    got = after.get(s)
                    if got is None or v + skip > got[0]:
                        after[s] = (v + skip, path)
            states = after
        score, path = max(((v + lp[s * ALPHABET], path) for s, (v, path) in states.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            path, x = path
            out.append(x)
        return score, "".join(reversed(out))

    def __call__(self, signs: str) -> tuple[str, ...]:
        """The words of the likeliest reading. Of more than three equal signs three count."""
        signs = _LONG_RUN.sub(r"\1\1\1", signs)
        if (got := self.known.get(signs)) is None:
            if len(self.known) > CACHE:
                self.known = {}
            got = self.known[signs] = tuple(self.best(signs)[1].split())
        return got


def words_of(token: str) -> tuple[list[str], str | None]:
    """Plain words of a token without white space, and its lattice if it looks disguised."""
    low = token.lower()
    if low.isalpha() and not _THRICE.search(low):
        return [low], None
    core = low.strip(".,;:?\"()[]{}<>%&#*~=")
    core = re.sub(r"^[!|]+(?=[!|\W])|([!|*%&#])\1+$|!+$", "", core).strip(".,;:?%&#*")
    if core.isalpha() and not _THRICE.search(core):
        return [core], None
    plain = _WORD.findall(core)
    odd = any(c in LEET or c in SEPARATORS for c in core) or _THRICE.search(core)
    # digits and points alone are a number
    return plain, core if odd and (plain or any(c in LEET and not c.isdigit() for c in core)) else None


def stretches(text: str) -> Iterator[str]:
    """Lattices of runs of three or more fragments: tokens of one or two letters or signs that
    may stand for letters. The narrowest blanks of a run, next to a single sign, may be inside a word."""
    for m in _SHORT_TOKENS.finditer(text):
        parts = _BLANKS.split(m[0].lower())
        size = [sum(c.isalpha() or c in LEET for c in t) for t in parts[::2]]
        a = 0
        for b in range(len(size) + 1):
            if b < len(size) and 1 <= size[b] <= 2:
                continue
            run = parts[2 * a : 2 * b - 1]
            if b - a >= 3 and any(map(str.isalpha, "".join(run))):
                least = min(map(len, run[1::2]))
                near = [len(g) == least and 1 in (size[a + k], size[a + k + 1]) for k, g in enumerate(run[1::2])]
                yield run[0] + "".join((NARROW if n else WIDE) + t for n, t in zip(near, run[2::2]))
            a = b + 1


def restore(text: str, decode: Decoder) -> set[str]:
    """The distinct words of a text, with what disguised ones stand for."""
    out: set[str] = set()
    for t in set(text.split()):
        plain, lattice = words_of(t)
        out.update(plain)
        if lattice:
            out.update(decode(lattice))
    for lattice in stretches(text):
        out.update(decode(lattice))
    return out


def features(word: str) -> list[str]:
    """The word, and its first 4, 5 and 6 letters."""
    return ["=" + word, *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]


def _sql_features(words):
    one = lambda w: F.array_compact(F.array(F.concat(F.lit("="), w), *(F.when(F.length(w) >= n, F.concat(F.lit(str(n)), F.substring(w, 1, n))) for n in (4, 5, 6))))
    return F.array_distinct(F.flatten(F.transform(words, one)))


#: Signs that may stand for the same letter, as one letter.
_SAME = {c: "i" if x in ("l", "i", "il") else x for c, x in LEET.items()} | {"l": "i"}


class _Skeleton(dict):
    def __missing__(self, code: int):
        c = chr(code)
        self[code] = out = _SAME.get(c, c) if c in _SAME or c.isalpha() else None
        return out


_TABLE = _Skeleton()


def skeleton(signs: str) -> str:
    """What is common to all that a lattice can spell: each word of any path is, as a skeleton, a part of it."""
    return _REPEATED.sub(r"\1", signs.translate(_TABLE))


class Scorer:
    """Weights of the features that a text holds."""

    def __init__(self, model: np.ndarray, feats: list[str], weights: np.ndarray, bias: float):
        self.decode, self.index, self.weights, self.bias = Decoder(model), {f: i for i, f in enumerate(feats)}, weights.tolist(), bias
        self.heads = {f[1:5] for f in feats}  # of every feature, and so of every word that has one
        self.parts = ahocorasick.Automaton()
        for f in feats:
            self.parts.add_word(skeleton(f[1:]), True)
        if feats:
            self.parts.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}

    def _of_words(self, words) -> set[int]:
        return {self.index[f] for w in words if w[:4] in self.heads for f in features(w) if f in self.index}

    def _of_lattice(self, signs: str) -> set[int]:
        spells = self.index and next(self.parts.iter(skeleton(signs)), None)
        return self._of_words(self.decode(signs)) if spells else set()

    def _of_token(self, token: str) -> tuple[int, ...]:
        plain, lattice = words_of(token)
        got = self._of_words(plain) | (self._of_lattice(lattice) if lattice else set())
        if len(self.known) > CACHE:
            self.known = {}
        self.known[token] = out = tuple(got)
        return out

    def found(self, text: str) -> set[int]:
        out: set[int] = set()
        known = self.known.get
        for t in set(text.split()):
            f = known(t)
            if f is None:
                f = self._of_token(t)
            if f:
                out.update(f)
        for signs in stretches(text):
            out |= self._of_lattice(signs)
        return out

    def __call__(self, text: str) -> float:
        s = self.bias + sum(self.weights[x] for x in sorted(self.found(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


def _words(model: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(model)
        for batch in slices(it):
            got = [sorted(restore(x or "", decode)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.string()))], names=["toxic", "words"])

    return run


def _rows(feats: list[str]):
    index = {f: i for i, f in enumerate(feats)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            got = [sorted({index[f] for w in words for f in features(w) if f in index}) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], names=["toxic", "at"])

    return run


def fit(rows: list[list[int]], y: np.ndarray, k: int, rounds: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic weights of k features and the bias; rows: the features that each row holds."""
    n, p = len(rows), float(y.mean()) if len(y) else 0.0
    if not n or p in (0.0, 1.0):
        return np.zeros(k), 4.0 * (2 * p - 1) if n else -4.0
    d = np.repeat(np.arange(n), [len(r) for r in rows])
    c = np.array([x for r in rows for x in r], np.int64)
    held = np.maximum(np.bincount(c, minlength=k), 1)
    w, b = np.zeros(k), math.log(p / (1 - p))
    vw, vb = np.zeros(k), 0.0
    step = 4.0 / max(1.0, np.bincount(d, minlength=n).max(initial=0) ** 0.5 + 1)
    for _ in range(rounds):  # gradient steps with momentum
        f = np.bincount(d, w[c], n) + b
        g = 1 / (1 + np.exp(-f)) - y
        gw = np.bincount(c, g[d], k) / held**0.5 / n**0.5 * 2 + l2 * w
        vw, vb = 0.9 * vw - step * gw, 0.9 * vb - step * g.mean()
        w, b = w + vw, b + vb
    return w, float(b)


def learn(sample: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Features, weights and bias from rows (toxic, words). Features that go with label 1 beyond
    chance (3 rows, z 4, half of their rows) are found on the executors; they and the bounded
    sample's rows over them are all that comes to the driver."""
    n, p = sample.agg(F.count("*"), F.avg("toxic")).first()
    feats: list[str] = []
    if n and p not in (0.0, 1.0):
        each = sample.select("toxic", F.explode(_sql_features(F.col("words"))).alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1"))
        z = (F.col("n1") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p) + 1e-9)
        feats = sorted(r.f for r in each.where((F.col("n1") >= 3) & (z >= 4) & (F.col("n1") >= 0.5 * F.col("n"))).collect())
    got = sample.select("toxic", "words").mapInArrow(_rows(feats), "toxic int, at array<int>").toArrow()
    order = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))  # the same sums however rows arrive
    return feats, *fit([at for _, at in order], np.array([t for t, _ in order], float), len(feats))


_last: list = [None, None]  #: the scorer of the last model that this worker has seen


def _score(model: np.ndarray, feats: list[str], weights: np.ndarray, bias: float):
    name = uuid.uuid4().hex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _last[0] != name:
            _last[:] = name, Scorer(model, feats, weights, bias)
        scorer = _last[1]
        for batch in slices(it):
            scores = [scorer(text or "") for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "score"])

    return run


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 3 == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000) -> DataFrame:
    """docs with a column score (0 to 1): how likely label toxic = 1 is.

    docs: doc_id, text and any others; labels: doc_id, toxic. Labels are learned from rows
    whose crc32(doc_id) mod 3 is not 1, a hashed sample of about fit_rows of them; score
    depends on text alone. Null text: as empty. Very long texts and tokens are read whole, in
    linear time. Repeated rows come out as often as they come in; of several labels of an id
    the greatest counts. No usable label: every score is that of no evidence. A column score of
    docs is replaced; any other column, whatever its name, is passed through."""
    model = char_model(docs)
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    chosen = usable.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < min(1.0, fit_rows / max(n, 1)) * 1_000_000)
    # about fit_rows ids: a bound that the corpus does not move
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), docs.doc_id == chosen.label_id)
    sample = materialise(known.select("toxic", F.col("text").cast("string")).mapInArrow(_words(model), "toxic int, words array<string>"), "sample")
    feats, weights, bias = learn(sample)
    cols = [c for c in docs.columns if c != "score"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cols), "score double"])
    return docs.select(F.col("text").cast("string").alias("docweave_text"), *cols).mapInArrow(_score(model, feats, weights, bias), schema)
