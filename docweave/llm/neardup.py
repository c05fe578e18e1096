"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

Sketch: rounds of hashed bin placement. In round i every shingle falls into one of t
bins and empty bins take the smallest value of the round; after t rounds, round t+j
puts all shingles into bin j, so every coordinate fills. Two sets agree in a
coordinate with probability J, and the number of agreements is concentrated as if the
coordinates were independent. Short sets cost O(t log t), long ones O(n).

Scale: a first pass turns texts into a set fingerprint, the band keys and a one-byte
sketch; texts are never shuffled for candidates. Sets that are equal are one class
from then on, so groups of exact copies of any size are one row. A band bucket links
its members to its smallest id only (a star), which settles nearly all. Members of
buckets that still hold several components are paired again by their rarest shingles
(prefix filter, exact), tile by tile on their sketches; what a concentration bound
cannot rule out is verified on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, skew_join
from ._vec import batches, mix, shingle_sets, slices
from .components import components

T, ROWS = 128, 4  #: coordinates; coordinates in a band: a pair at 0.75 misses all 32 bands with probability 5e-6
TILE = 512
#: Of 128 coordinates a pair at 0.75 agrees in fewer than 68 with probability below 1e-7 (binomial tail).
LEAST_AGREE = 68
_EMPTY = np.uint64(2**64 - 1)
_SEED = mix(np.arange(1001, 1001 + 2 * T, dtype=np.uint64))
_BAND = mix(np.arange(5001, 5001 + T, dtype=np.uint64)) | np.uint64(1)


def sketches(sets: np.ndarray, bounds: np.ndarray, t: int = T) -> np.ndarray:
    """(number of sets) x t fast similarity sketch; a row of an empty set holds the largest value."""
    n = len(bounds) - 1
    out = np.full((n, t), _EMPTY, np.uint64)
    sizes = np.diff(bounds)
    live = np.flatnonzero(sizes)
    owner = np.repeat(np.arange(n), sizes)
    row = np.full(n, -1)
    el = sets
    for i in range(t):
        if not len(live):
            break
        row[live] = np.arange(len(live))
        v = mix(el ^ _SEED[i])
        got = np.full(len(live) * t, _EMPTY, np.uint64)
        np.minimum.at(got, row[owner] * t + (v % np.uint64(t)).astype(np.int64), v)
        now = out[live]
        now = np.where(now == _EMPTY, got.reshape(-1, t), now)
        out[live] = now
        full = (now != _EMPTY).all(1)
        if full.any():
            row[live[full]] = -1
            keep = row[owner] >= 0
            owner, el, live = owner[keep], el[keep], live[~full]
    if len(live):
        starts = np.searchsorted(owner, live)
        for j in range(t):
            low = np.minimum.reduceat(mix(el ^ _SEED[t + j]), starts)
            now = out[live, j]
            out[live, j] = np.where(now == _EMPTY, low, now)
    return out


def _lower(texts: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [(x or "").encode().lower() for x in texts.to_pylist()]  # bytes.lower() maps A-Z only


def _signatures(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            ids, texts = batch.column(0), _lower(batch.column(1))
            for a, b in batches(texts):
                sets, bounds = shingle_sets(texts[a:b], k)
                n = np.diff(bounds)
                fill = np.repeat(np.arange(b - a), n)
                fp = [np.zeros(b - a, np.uint64) for _ in range(2)]
                for s, salt in zip(fp, (11, 12)):
                    np.add.at(s, fill, mix(sets ^ np.uint64(salt)))
                sk = sketches(sets, bounds)
                bands = mix((sk * _BAND).reshape(b - a, -1, ROWS).sum(2, dtype=np.uint64) + np.arange(T // ROWS, dtype=np.uint64)).view(np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, T // ROWS, 0)))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], pa.array(n.astype(np.int64)), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)),
                     pa.ListArray.from_arrays(offsets, pa.array(bands[n > 0].reshape(-1))), pa.array([x.tobytes() for x in sk.astype(np.uint8)], pa.binary())],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"],
                )

    return run


def _sets(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            ids, texts = batch.column(0), _lower(batch.column(1))
            for a, b in batches(texts):
                sets, bounds = shingle_sets(texts[a:b], k)
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["id", "set"])

    return run


def _tiles(members: DataFrame) -> DataFrame:
    """Members of unsettled keys, dealt to pairs of tiles of about TILE rows."""
    # a hashed tile number: the tiles of a bucket of s members hold about TILE / 2 each
    dealt = members.withColumn("tiles", F.ceil(F.col("size") / (TILE // 2)).cast("int")).withColumn("tile", F.pmod(F.xxhash64("id", "key"), F.col("tiles")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "component", "n_shingles", "rest", "sketch")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(id, key, n, rest): the rarest shingles of each set of n, so many that two sets similar
    enough share one, and how many shingles come from there on (positional filter).

    Of n shingles in any common order, sets with percent of their union in common agree in one
    of the first n - ceil(n * percent / 100) + 1. Rarest first leaves out the passages that
    many documents share, and the edits that each near copy has for itself pair with nothing."""
    each = sets.select("id", F.size("set").alias("n"), F.explode("set").alias("key"))
    shared = materialise(each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    own = skew_join(each, shared, "key", "df").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("of"))
    alone = F.col("n") - F.size("of")  # shingles that no other set has come first and pair with nothing
    length = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone).cast("int")
    placed = own.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("of", F.lit(1), length)).alias("at", "of"))
    return placed.select("id", "of.key", "n", (F.col("n") - F.col("alone") - F.col("at")).cast("int").alias("rest"))


def _needed(n, m, percent: int):
    """Common shingles that sets of n and m must have, as a fraction to compare with."""
    return (n + m) * (percent / (100 + percent)) - 1e-6


def _compare(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf.i.iloc[0], pdf.j.iloc[0]
        left = pdf[pdf.tile == i].sort_values("n_shingles")
        right = left if i == j else pdf[pdf.tile == j].sort_values("n_shingles")
        found = []
        if len(left) and len(right):
            ls, rs = (np.frombuffer(b"".join(x.sketch), np.uint8).reshape(len(x), -1) for x in (left, right))
            lid, rid, lc, rc, ln, rn = left.id.to_numpy(), right.id.to_numpy(), left.component.to_numpy(), right.component.to_numpy(), left.n_shingles.to_numpy(), right.n_shingles.to_numpy()
            lr, rr = left.rest.to_numpy(), right.rest.to_numpy()
            for x in range(len(left)):
                a, b = np.searchsorted(rn, -(-ln[x] * percent // 100)), np.searchsorted(rn, ln[x] * 100 // percent, "right")
                near = np.flatnonzero((np.minimum(rr[a:b], lr[x]) >= _needed(ln[x], rn[a:b], percent)) & (rc[a:b] != lc[x])) + a
                if i == j:
                    near = near[rid[near] > lid[x]]
                if len(near):
                    agree = (rs[near] == ls[x]).sum(1)
                    found += [(min(lid[x], rid[y]), max(lid[x], rid[y]), int(g)) for y, g in zip(near, agree) if g >= LEAST_AGREE * percent // 75]
        return pd.DataFrame(found, columns=["v", "u", "agree"]).astype("int64")

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets have percent of their union in common."""
    a, b = sets.select(F.col("id").alias("u"), F.col("set").alias("us")), sets.select(F.col("id").alias("v"), F.col("set").alias("vs"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v").withColumn("inter", F.size(F.array_intersect("us", "vs")))
    return both.where(F.col("inter") * 100 >= percent * (F.size("us") + F.size("vs") - F.col("inter"))).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Rows whose sets of k-word shingles have Jaccard similarity of percent/100 or more
    are linked; component_id is the smallest id reachable over links. Null or empty
    texts have no shingles and are linked with nothing. Rows with a null id keep a
    null component and are kept. Repeated rows (same id) come out as often as they
    come in. Other columns are ignored."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = own.mapInArrow(_signatures(k), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary")
    sig = materialise(sig, "signatures")
    linked = sig.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(linked.groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = linked.join(classes.select(F.col("rep").alias("doc_id"), F.col("n_shingles").alias("n_rep")), "doc_id").where("n_shingles = n_rep")
    members = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    buckets = members.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("size")).where("hub < last")
    members = materialise(skew_join(members, materialise(buckets, "buckets"), "key", "size").select("key", "id", "hub", "size"), "members")

    involved = members.select("id").distinct()
    sets = materialise(own.join(involved, own.doc_id == involved.id, "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(k), "id long, set array<long>"), "sets")
    size_of = sets.select("id", F.size("set").alias("n"))
    star = members.where("id > hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()
    near = star.join(size_of.select(F.col("id").alias("u"), F.col("n").alias("nu")), "u").join(size_of.select(F.col("id").alias("v"), F.col("n").alias("nv")), "v")
    links = materialise(_verify(near.where(F.least("nu", "nv") * 100 >= percent * F.greatest("nu", "nv")), sets, percent), "links")
    found = components(links)

    # pairs of a bucket that lie in different components
    placed = members.join(found, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x < y and x is not null").select("key", "n")
    left = skew_join(placed, materialise(open_keys, "open"), "key", "n").where("size > 2")
    left = materialise(left.groupBy("id").agg(F.first("component").alias("component")), "left")
    shared = materialise(_prefixes(sets.join(left.select("id"), "id", "left_semi"), percent).join(left, "id"), "prefixes")
    low = shared.groupBy("key").agg(F.min("n").alias("low"))
    least = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100))
    shared = shared.join(low, "key").where(F.col("rest") >= _needed(F.col("n"), least, percent))  # too late for any partner
    mixed = shared.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key", "size")
    shared = shared.join(mixed, "key").join(reps.select(F.col("doc_id").alias("id"), "n_shingles", "sketch").dropDuplicates(["id"]), "id")
    pairs = _tiles(shared).groupBy("key", "i", "j").applyInPandas(_compare(percent), "v long, u long, agree long")
    pairs = materialise(pairs.distinct().join(star, ["u", "v"], "left_anti"), "pairs")
    if pairs.limit(1).count():
        comp = found.withColumnRenamed("component", "c")
        at = lambda p, c, side: p.join(c.select(F.col("id").alias(side), F.col("c").alias("c" + side)), side, "left").withColumn("c" + side, F.coalesce("c" + side, side))
        # first the likeliest partner of each id in each other component, then whatever that has not joined
        both = at(at(pairs, comp, "u"), comp, "v")
        best = both.groupBy("u", "cv").agg(F.max_by("v", "agree").alias("v")).select("u", "v").union(both.groupBy("v", "cu").agg(F.max_by("u", "agree").alias("u")).select("u", "v")).distinct()
        links = materialise(links.union(_verify(best, sets, percent)), "links")
        found = components(links)
        comp = found.withColumnRenamed("component", "c")
        rest = at(at(pairs, comp, "u"), comp, "v").where("cu != cv").join(best, ["u", "v"], "left_anti")
        more = materialise(_verify(rest, sets, percent), "links")
        if more.limit(1).count():
            found = components(links.union(more))

    of_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("n_shingles", "fp1", "fp2", F.coalesce("component", "rep").alias("found"))
    out = sig.select("doc_id", "n_shingles", "fp1", "fp2").join(of_class, ["n_shingles", "fp1", "fp2"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
