"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case. Numbers, names (capitalised words inside a
sentence) and units (a unit word after a number) become typed placeholders, so a
question whose numbers or names were changed has the same template. Template windows
of k words are hashed and joined by hash; a window of too few plain words is hashed with its
values as they are, so none is left out. Items shorter than k words have one window of their
own length, searched for in every document. The values behind the placeholders (slots) must
then map one to one between a document and an item, as a re-parameterised copy has them:
over all matches, over those of one occurrence (starts that lie close together), or over
those of one alignment. A verbatim copy always has such an alignment, whatever else the
document holds.

Scale: documents are read once. A bitmap of fixed size over the benchmark's window
hashes (BITS bits, whatever the benchmark's size) lets through few windows of other
text; only those are joined with the benchmark's windows, by hash, in SALTS shares of each
hash. Verdicts are keyed by a hash of id and text, so null and repeated ids are safe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise
from ._vec import _C, batches, hash_spans, mix, scan, slices, spans, table, test_bits

BITS = 22
SALTS = 16
#: Fixed value: words that count as a unit after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec ms min h hr hrs day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres mile miles kilometer kilometers kilogram kilograms gram grams pound pounds liter liters litre litres percent dollar dollars euro euros cent cents degree degrees eur usd".split()
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974))
_STOP = table(b".!?:;")


def _unit_hashes() -> np.ndarray:
    buf = np.frombuffer(" ".join(UNITS).encode() + b" ", np.uint8)
    return np.sort(hash_spans(buf, *spans(buf)))


_UNITS = _unit_hashes()


def templates(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Template hash and value hash of every word, whether it is a number or unit, whether it
    is a name, whether it is a plain word (not punctuation alone), and bounds of each text's words."""
    w = scan(b"\n".join(texts), bare=True)
    bounds = np.searchsorted(w.starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    n = len(w.starts)
    fresh = np.ones(n, bool)  # begins a text, a sentence or a line
    if n:
        fresh[1:] = _STOP[w.last[:-1]] | (w.line[1:] > w.line[:-1])
        fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    unit = np.zeros(n, bool)
    unit[1:] = w.number[:-1] & (_UNITS[np.minimum(np.searchsorted(_UNITS, w.hash[1:]), len(_UNITS) - 1)] == w.hash[1:])
    name = w.capital & ~fresh & ~w.number & ~unit
    shape = np.where(w.number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, w.hash)))
    return shape, w.hash, w.number | unit, name, w.some & ~(w.number | unit | name), bounds


def _keys(shape, value, name, plain, size: int, least_words: int):
    """Of each window of size words: its hash, and whether it is a template's. A name in the
    first place counts as a plain word, for it may only begin a sentence."""
    n = len(shape) - size + 1
    t, v = np.where(name, value, shape)[:n] * _C[0], value[:n] * _C[0]
    for j in range(1, size):
        t += shape[j : n + j] * _C[j]
        v += value[j : n + j] * _C[j]
    count = np.concatenate(([0], np.cumsum(plain)))
    is_template = count[size:] - count[:-size] + name[:n] >= least_words
    return mix(np.where(is_template, mix(t), mix(v) + _C[40])) + _C[41] * np.uint64(size), is_template


def _rows(shape, value, slot, name, plain, bounds, sizes: list[int], least_words: int, item_of: int | None, wanted: bytes | None):
    """(text, place, size, hash, slots) of the windows of each text. sizes: window lengths to
    look for in documents; item_of: for items, windows of so many words, or one of all words of a
    shorter one. A text of under least_words words has one window of all its words, which only
    such a text can match. wanted: bitmap of hashes to let through."""
    length = np.diff(bounds)
    owner = np.repeat(np.arange(len(length)), length)
    for size in range(least_words, item_of + 1) if item_of else sizes:
        if len(shape) < size:
            continue
        h, is_template = _keys(shape, value, name, plain, size, least_words)
        at = owner[: len(h)]
        ok = bounds[at + 1] >= np.arange(len(h)) + size
        if item_of and size < item_of:
            ok &= length[at] == size
        if wanted is not None:
            ok &= test_bits(wanted, h)
        for p in np.flatnonzero(ok).tolist():
            q = p + 1 if name[p] else p
            e = p + size
            yield at[p], p - bounds[at[p]], size, h[p], value[q:e][(slot | name)[q:e]] if is_template[p] else value[:0]
    for i in np.flatnonzero((length > 0) & (length < least_words)).tolist():
        a, b = bounds[i], bounds[i + 1]
        h = mix((value[a:b] * _C[: b - a]).sum(keepdims=True, dtype=np.uint64) + _C[42])
        if wanted is None or test_bits(wanted, h)[0]:
            yield i, 0, int(b - a), h[0], value[:0]


_SCHEMA = "key long, place long, size int, hash long, slots array<long>"


def _windows(sizes: list[int], least_words: int, item_of: int | None, bitmap: bytes | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            keys, texts = batch.column(0).to_pylist(), [(x or "").encode() for x in batch.column(1).to_pylist()]
            for a, b in batches(texts):
                rows = list(_rows(*templates(texts[a:b]), sizes, least_words, item_of, bitmap))
                if rows:
                    who, place, size, h, slots = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[a + i] for i in who], pa.int64()), pa.array(place, pa.int64()), pa.array(size, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array([s.view(np.int64) for s in slots], pa.list_(pa.int64()))],
                        names=["key", "place", "size", "hash", "slots"],
                    )

    return run


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def bitmap_of(df: DataFrame, col: str, bits: int) -> bytes:
    """Packed bitmap of the low bits of a column's numbers. At most 2**bits / 1024 rows, each a
    word of 1,024 bits, come to the driver."""
    low = F.col(col).bitwiseAND(F.lit((1 << bits) - 1))
    words = df.select(low.alias("b")).distinct().groupBy(F.shiftright("b", 10).alias("w")).agg(F.collect_set((F.col("b") % 1024).cast("short")).alias("bits"))
    out = np.zeros(1 << bits, bool)
    for w, b in words.toLocalIterator():
        out[np.array(b, np.int64) + (w << 10)] = True
    return np.packbits(out).tobytes()


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 8, least_words: int = 4, least_share: float = 0.5, least_run: int = 6) -> DataFrame:
    """Matches (key, item_id, n_matched, n_item_windows, coverage) of documents that hold an item.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. key is
    row_key. An item counts as held if least_run of its windows, or least_share of them, are in
    one group of matches whose slots map one to one: all matches of the document, one
    occurrence, or one alignment. An item of under least_words words counts only where it is the
    whole document. Null and empty texts match nothing; an empty benchmark gives no row; repeated
    rows and items count once each. Very long texts are read whole, in parts."""
    items = benchmark.select(F.col("item_id").cast("long").alias("key"), F.col("text").cast("string"))
    bench = materialise(items.mapInArrow(_windows([], least_words, k, None), _SCHEMA), "bench")
    sizes = sorted(r[0] for r in bench.select("size").distinct().where(F.col("size") >= least_words).collect())  # at most k
    bits = bitmap_of(bench, "hash", BITS)
    own = docs.select(row_key("doc_id", "text").alias("key"), F.col("text").cast("string"))
    seen = materialise(own.mapInArrow(_windows(sizes, least_words, None, bits), _SCHEMA).dropDuplicates(["key", "place", "size"]), "windows")
    # equal windows of an item are one, at the first of their places
    b = bench.groupBy(F.col("key").alias("item_id"), "hash", F.col("slots").alias("item_slots")).agg(F.min("place").alias("item_place"))
    count = bench.groupBy(F.col("key").alias("item_id")).agg(F.countDistinct("hash").alias("n_item_windows"))
    salted = b.join(count, "item_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = seen.withColumn("salt", F.pmod(F.xxhash64("key", "place"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"]).where(F.size("slots") == F.size("item_slots"))
    hit = hit.withColumn("start", F.col("place") - F.col("item_place"))
    # an occurrence: starts without a step of more than a tenth of the item, and two words
    w = Window.partitionBy("key", "item_id").orderBy("start")
    step = F.col("start") - F.lag("start").over(w) > 2 + (F.col("n_item_windows") + k - 1) / 10
    hit = hit.withColumn("step", F.coalesce(step, F.lit(False)).cast("long")).withColumn("occurrence", F.sum("step").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    groups = F.array(*(F.struct(F.lit(n).alias("kind"), F.col(c).cast("long").alias("of")) for n, c in ((1, "start"), (2, "occurrence"))), F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("of")))
    by = ["key", "item_id", "n_item_windows", "kind", "of"]
    each = hit.select("key", "item_id", "n_item_windows", F.explode(groups).alias("g"), "hash", "item_slots", "slots").select("key", "item_id", "n_item_windows", "g.kind", "g.of", "hash", "item_slots", "slots")
    enough = (F.col("n_matched") >= least_run) | (F.col("n_matched") >= least_share * F.col("n_item_windows"))
    full = each.groupBy(*by).agg(F.countDistinct("hash").alias("n_matched")).where(enough)
    pairs = each.select(*by, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).distinct()
    n = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("s.item_slots").alias("na"), F.countDistinct("s.slots").alias("nb"))
    mixed = n.where((F.col("n") > F.col("na")) | (F.col("n") > F.col("nb"))).select(*by)
    out = full.join(mixed, by, "left_anti").groupBy("key", "item_id", "n_item_windows").agg(F.max("n_matched").alias("n_matched"))
    return out.select("key", "item_id", "n_matched", "n_item_windows", (F.col("n_matched") / F.col("n_item_windows")).alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns as they are, whatever their names."""
    bad = contaminated(docs, benchmark, **kw).select(F.col("key").alias("docweave_key")).distinct()
    marked = docs.withColumn("docweave_key", row_key("doc_id", "text"))
    return marked.join(bad, "docweave_key", "left_anti").select(*docs.columns)


def contamination_report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """For each row of docs: doc_id, contaminated, n_items, item_id and coverage of the
    item held most fully (ties: smallest id; null if none)."""
    m = contaminated(docs, benchmark, **kw)
    best = m.groupBy("key").agg(F.count("*").alias("n_items"), F.max(F.struct("coverage", -F.col("item_id"))).alias("top"))
    own = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("key"))
    return own.join(best, "key", "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        (-F.col("top.col2")).alias("item_id"), F.col("top.coverage").alias("coverage"))
