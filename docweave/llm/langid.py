"""Language identification by hierarchical discrimination.

Hashed character 1- to 3-grams. A linear support vector machine for each family
against the rest predicts the family first; within it, one-versus-one linear support
vector machines tell the languages apart by votes, ties by margin.

Scale: fitted on a hashed sample of about fit_rows labelled rows (bounded, on the
driver); prediction is one pass over the texts, vectorised in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import held_out

DIM = 4096
#: Language families. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "de en nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn mr gu pa ne",
    "semitic": "ar he am mt",
}
FAMILY = {x: f for f, xs in FAMILIES.items() for x in xs.split()}
_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
_A, _B, _C = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def vectors(texts: list[str], block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Row for each text: square roots of gram counts, of length 1; and whether it has a letter."""
    out = np.zeros((len(texts), DIM), np.float32)
    some = np.zeros(len(texts), bool)

    def add(parts: list[tuple[int, str]]) -> None:
        cp = np.frombuffer(" ".join(["", *(t for _, t in parts), ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        low = [len(t.lower()) for _, t in parts]
        rows = np.zeros(len(cp), np.int64)
        begin = np.cumsum([1, *(n + 1 for n in low)])
        rows[begin[1:-1]] = 1
        rows = np.cumsum(rows)
        letter = _LETTER[np.minimum(cp, 0xFFFF)]
        if (high := np.flatnonzero(cp > 0xFFFF)).size:
            kinds, at = np.unique(cp[high], return_inverse=True)
            letter[high] = np.array([chr(x).isalpha() for x in kinds.tolist()])[at]
        c = np.where(letter, cp, 32).astype(np.uint32)
        mid = np.flatnonzero(letter)
        if not len(mid):
            return
        mid = mid[(mid > 0) & (mid < len(c) - 1)]
        x, a, b = c[mid], c[mid - 1], c[mid + 1]
        r = np.array([i for i, _ in parts], np.int64)
        row = np.searchsorted(begin, mid, "right") - 1
        width = len(parts)
        for h in (x * _A, x * _A + b * _B, (a * _C) ^ (x * _A + b * _B) + np.uint32(7)):
            h = h ^ (h >> np.uint32(15))
            h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
            got = np.bincount(row * DIM + h, minlength=width * DIM).reshape(width, DIM)
            if len(parts) == 1 or (np.diff(r) > 0).all():
                out[r] += got
            else:  # a long text has several parts
                np.add.at(out, r, got.astype(np.float32))
        some[r[np.unique(row)]] = True

    parts, size = [], 0
    for i, t in enumerate(texts):
        for k in range(0, len(t), block):
            parts.append((i, t[k : k + block]))
            size += len(parts[-1][1])
            if size >= block or len(parts) >= 200:
                add(parts)
                parts, size = [], 0
    if parts:
        add(parts)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9), some


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 80) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine, squared hinge, y in -1, 1.
    Classes count alike. Accelerated gradient steps."""
    n = len(y)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) * c / n
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    step = 1 / (1 + 4 * c)
    for k in range(rounds):
        m = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight * y
        g = v - 2 * np.append(x.T @ m, m.sum()).astype(np.float32)
        g[-1] = -2 * m.sum()
        new = v - step * g
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


class Model:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        family = np.array([FAMILY.get(z, z) for z in lang.tolist()])
        self.families = sorted(set(family.tolist()))
        self.within = {f: [z for z in self.langs if FAMILY.get(z, z) == f] for f in self.families}
        side = lambda mask: np.where(mask, 1, -1).astype(np.float32)
        self.first = [svm(x, side(family == f)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for f, ls in self.within.items():
            for a, b in combinations(ls, 2):
                own = (lang == a) | (lang == b)
                self.pairs[a, b] = svm(x[own], side(lang[own] == a))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        sure = lambda m: 1 / (1 + np.exp(-4 * m))
        if self.first:
            m = np.stack([x @ w[:-1] + w[-1] for w in self.first], 1)
            fam, score = m.argmax(1), sure(m.max(1))
        else:
            fam, score = np.zeros(n, int), np.ones(n)
        out = np.empty(n, object)
        for k, f in enumerate(self.families):
            own, ls = np.flatnonzero(fam == k), self.within[f]
            votes, margin = np.zeros((len(own), len(ls))), np.zeros((len(own), len(ls)))
            for (i, a), (j, b) in combinations(enumerate(ls), 2):
                w = self.pairs[a, b]
                m = x[own] @ w[:-1] + w[-1]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                margin[:, i] += m
                margin[:, j] -= m
            best = (votes + 1e-3 * np.tanh(margin)).argmax(1) if len(own) else np.zeros(0, int)
            out[own] = [ls[i] for i in best]
            if len(ls) > 1:
                score[own] = score[own] * sure(margin[np.arange(len(own)), best] / (len(ls) - 1))
        return out.tolist(), np.clip(score, 0, 1).astype(np.float64)


def _sample(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for k in range(0, batch.num_rows, 500):
            x, some = vectors([t or "" for t in batch.column(1)[k : k + 500].to_pylist()])
            rows = [(np.flatnonzero(r).astype(np.int16)) for r in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[k : k + 500], pa.array(some), pa.array(rows, pa.list_(pa.int16())), pa.array([r[i] for r, i in zip(x, rows)], pa.list_(pa.float32()))], names=["lang", "some", "at", "value"]
            )


def _predict(model: Model | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                x, some = vectors([t or "" for t in part.column(0).to_pylist()])
                lang, score = model.predict(x) if model else (["und"] * len(x), np.zeros(len(x)))
                lang = [z if s else "und" for z, s in zip(lang, some.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(lang, pa.string()), pa.array(np.where(some, score, 0.0).astype(np.float64))], names=[*part.schema.names[1:], "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, fit_rows: int = 4000) -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    Learned from text and non-null lang of rows whose crc32(doc_id) mod 3 is not 1, a hashed
    sample of about fit_rows of them; a prediction depends on text alone. Text that is null
    or has no letter: und, score 0; so is every text if there is nothing to learn from.
    Very long texts are read whole, in parts. Equal votes go to the greater margin, then to the
    first language by name. Repeated rows come out as often as they come in. Columns of docs with
    those names are replaced; docweave_text must not be one of them."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text", "doc_id")
    n = learn.select("lang").count()
    chosen = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1.0, fit_rows / max(n, 1)) * 1_000_000)
    got = chosen.select("lang", F.col("text").cast("string")).mapInArrow(_sample, "lang string, some boolean, at array<short>, value array<float>").where("some").toPandas()
    model = None
    if len(got):
        x = np.zeros((len(got), DIM), np.float32)
        for i, (a, v) in enumerate(zip(got["at"], got["value"])):
            x[i, np.asarray(a, np.int64)] = v
        model = Model(x, got["lang"].to_numpy())
    cols = [c for c in docs.columns if c not in ("lang_pred", "score")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cols), "lang_pred string", "score double"])
    return docs.select(F.col("text").cast("string").alias("docweave_text"), *cols).mapInArrow(_predict(model), schema)
