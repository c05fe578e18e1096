"""Best-fit packing of tokenised documents into sequences of fixed length.

Linear grouping: pieces longer than a small share of a sequence are sorted and cut into
groups of equal cardinality, and every length counts as the largest of its group, so
few sizes remain. A configuration programme over those sizes (column generation with a
knapsack, solved as a linear programme and rounded down) says how often each
combination of sizes is used; actual pieces are substituted for the rounded sizes, and
what is left, then the small pieces, go by best fit into the room that remains.

Scale: lengths are whole numbers up to the capacity, so the driver plans on the
histogram of lengths (at most `capacity` numbers, whatever the corpus) and the plan
is a list of runs: "ranks a to b among the pieces of length l go to sequences s, s+1,
...". Executors rank the pieces of a length in hashed shares, so one very frequent
length is dealt to many tasks, and look their place up in the plan.
"""

from __future__ import annotations

import bisect
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise
from ._vec import batches, hash_spans, slices, spans

#: Bounds of the caches of each Python worker (entries); they are emptied when full.
WORDS, PARTS = 1_000_000, 400_000


class Encoder:
    """Token ids of whole texts, by a cache of words in front of the tokenizer.

    The tokenizer drops white space and never joins two words, so a text's ids are
    those of its words in a row. A new word of Latin letters, or of ASCII, is cut into the
    tokenizer's own pre-tokens and its BPE model run on those not seen yet; any other
    word goes to the tokenizer as it is. Words are known by a 64-bit hash."""

    #: Fixed value: the pre-token pattern of word_bpe_49k.json, on lower-case text.
    _parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    _plain = regex.compile(r"[\x21-\x7e]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level BPE: the other bytes move to U+0100 and up
        self.bytes = {b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.parts: dict[str, list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.at = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64)
        self.size, self.at[0] = 0, 0

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes)
            ids = self.parts[part] = [t.id for t in self.model.tokenize(mapped)]
        return ids

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        if len(self.parts) > PARTS:
            self.parts = {}
        flat: list[int] = []
        counts = []
        for w in words:
            n = len(flat)
            s = w.decode()
            core = s.rstrip(".,")
            if core.isalpha() and (core.isascii() or (max(core) <= "\u024f" and "\u0130" not in core)):
                flat += self._part(core.lower())
                if len(core) < len(s):
                    flat += self._part(s[len(core) :])
            elif "<|" in s or not self._plain.fullmatch(s):
                flat += self.tok.encode(s, add_special_tokens=False).ids
            else:
                for p in self._parts.findall(s.lower()):
                    flat += self._part(p)
            counts.append(len(flat) - n)
        k, need = len(self.known), self.size + len(flat)
        while need > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while k + len(words) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.ids[self.size : need] = flat
        self.at[k + 1 : k + 1 + len(words)] = self.size + np.cumsum(counts)
        self.size = need
        self.known.update(zip(hashes, range(k, k + len(words))))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and bounds of each text's."""
        if len(self.known) > WORDS:
            self._reset()
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts, ends = spans(buf)
        h = hash_spans(buf, starts, ends)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        get = self.known.get
        where = np.array([get(x, -1) for x in uniq.tolist()], np.int64)
        if len(new := np.flatnonzero(where < 0)):
            raw, f = buf.tobytes(), first[new]
            self._learn(uniq[new].tolist(), [raw[a:b] for a, b in zip(starts[f].tolist(), ends[f].tolist())])
            where[new] = np.arange(len(self.known) - len(new), len(self.known))
        lo, n = self.at[where], self.at[where + 1] - self.at[where]
        counts = n[inverse]
        bounds = np.concatenate(([0], np.cumsum(counts)))
        take = np.arange(bounds[-1]) + np.repeat(lo[inverse] - bounds[:-1], counts)
        texts_at = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        return self.ids[take], bounds[texts_at]


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for batch in slices(it):
            doc_ids, texts = batch.column(0).to_pylist(), [(x or "").encode() for x in batch.column(1).to_pylist()]
            for a, b in batches(texts, 2 << 20):
                ids, bounds = enc(texts[a:b])
                rows = []
                for i in range(b - a):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    for k, s in enumerate(range(0, len(own), capacity)):
                        x = own[s : s + capacity]
                        rows.append((doc_ids[a + i], k, s, len(x), zlib.crc32(x), x if keep_ids else None))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(cols[c], pa.int64()) for c in (2, 3, 4)), *([pa.array(cols[5], pa.list_(pa.int64()))] if keep_ids else [])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])],
                )

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the tokens of each text and
    end_id after them, cut into pieces of capacity; a null or empty text is one piece [end_id]."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return own.mapInArrow(_pieces(tokenizer_path, capacity, end_id, keep_ids), schema)


def configurations(sizes: list[int], demand: list[int], capacity: int, max_columns: int = 400) -> list[tuple[list[int], float]]:
    """Configuration programme by column generation: (how many of each size, how often). After
    max_columns rounds the basis at hand is taken, which packs every piece too; more rounds (about
    1,100 to the optimum of 160 sizes) gave no fewer sequences in the best plan of plan_packing."""
    s, d = np.array(sizes), np.array(demand, float)
    g = len(s)
    cols = np.diag(capacity // s).astype(float)
    order = np.argsort(s)
    asc = s[order]
    for _ in range(max_columns):
        y = np.linalg.solve(cols.T, np.ones(g))  # what one piece of each size is worth
        worth = y[order]
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(asc[0]), capacity + 1):
            n = int(np.searchsorted(asc, c, "right"))
            v = best[c - asc[:n]] + worth[:n]
            k = int(v.argmax())
            if v[k] > best[c - 1] + 1e-12:
                best[c], pick[c] = v[k], k
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-6:
            break
        new, c = np.zeros(g), capacity
        while c >= asc[0]:
            if pick[c] < 0:
                c -= 1
                continue
            new[order[pick[c]]] += 1
            c -= int(asc[pick[c]])
        x, step = np.linalg.solve(cols, d), np.linalg.solve(cols, new)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        cols[:, int(ratio.argmin())] = new
    x = np.linalg.solve(cols, d)
    return [(cols[:, k].astype(int).tolist(), float(x[k])) for k in range(g) if x[k] > 1e-9]


class Plan:
    """Runs (length, first rank, count, first sequence, pieces of it in each sequence, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.used = capacity, [], 0
        self.rank: dict[int, int] = {}
        self.room: dict[int, list[tuple[int, int]]] = {}  # free tokens: (first sequence, how many)
        self.free: list[int] = []

    def put(self, length: int, count: int, seq: int, per: int, offset: int) -> None:
        a = self.rank.get(length, 0)
        self.runs.append((length, a, count, seq, per, offset))
        self.rank[length] = a + count

    def leave(self, room: int, seq: int, count: int) -> None:
        if count and room:
            if room not in self.room:
                bisect.insort(self.free, room)
            self.room.setdefault(room, []).append((seq, count))

    def open(self, count: int) -> int:
        self.used += count
        return self.used - count

    def best_fit(self, length: int, count: int) -> None:
        """Each piece into the fullest sequence that takes it, sequences of equal room in bulk."""
        while count:
            k = bisect.bisect_left(self.free, length)
            if k < len(self.free):
                room = self.free[k]
                seq, many = self.room[room].pop()
                if not self.room[room]:
                    del self.room[room]
                    self.free.pop(k)
            else:
                room = self.capacity
                many = -(-count // (room // length))
                seq = self.open(many)
            per = room // length
            full = min(many, count // per)
            if full:
                self.put(length, full * per, seq, per, self.capacity - room)
                self.leave(room - per * length, seq, full)
                count -= full * per
            if full < many and count:
                self.put(length, count, seq + full, count, self.capacity - room)
                self.leave(room - count * length, seq + full, 1)
                full, count = full + 1, 0
            self.leave(room, seq + full, many - full)

    def fill(self, slots: list[list[list[int]]], many: int) -> int:
        """Opens many sequences; slots hold runs [length, count] of their pieces, one for each sequence."""
        cuts = sorted({0, many, *(c for s in slots for c in np.cumsum([n for _, n in s]).tolist())})
        seq = self.open(many)
        for a, b in zip(cuts, cuts[1:]):
            at = 0
            for s in slots:
                ends = np.cumsum([n for _, n in s])
                k = int(np.searchsorted(ends, a, "right"))
                if k < len(s):
                    self.put(s[k][0], b - a, seq + a, 1, at)
                    at += s[k][0]
            self.leave(self.capacity - at, seq + a, b - a)
        return seq


def plan_packing(histogram: dict[int, int], capacity: int = 2048, groups: int = 160, small_shares: tuple[float, ...] = (0.34, 0.42, 0.5)) -> Plan:
    """The plan with the fewest sequences among those for each boundary between large and small pieces."""
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    best = None
    for share in small_shares:
        plan = _plan(histogram, capacity, groups, share)
        if best is None or plan.used < best.used:
            best = plan
        if best.used == least:
            break
    return best


def _plan(histogram: dict[int, int], capacity: int, groups: int, small_share: float) -> Plan:
    plan = Plan(capacity)
    small = int(capacity * small_share)
    large = sorted(((n, c) for n, c in histogram.items() if n > small and n < capacity), reverse=True)
    if full := histogram.get(capacity, 0):
        plan.put(capacity, full, plan.open(full), 1, 0)
    total = sum(c for _, c in large)
    each = max(1, math.ceil(total / groups))
    grouped: list[list[list[int]]] = []
    held = each
    for n, c in large:  # runs [length, count] of each group, in falling order of length
        while c:
            if held >= each:
                grouped.append([])
                held = 0
            k = min(c, each - held)
            grouped[-1].append([n, k])
            held, c = held + k, c - k
    sizes = [g[0][0] for g in grouped]
    merged: dict[int, list[list[int]]] = {}
    for s, g in zip(sizes, grouped):  # groups of one rounded size are one size
        merged.setdefault(s, []).extend(g)
    sizes = list(merged)
    if sizes:
        found = configurations(sizes, [sum(c for _, c in merged[s]) for s in sizes], capacity)
        for counts, often in sorted(found, key=lambda x: -x[1]):
            many = math.floor(often + 1e-6)
            slots = [_take(merged[s], many) for s, k in zip(sizes, counts) for _ in range(k)] if many else []
            if many := max((sum(c for _, c in s) for s in slots), default=0):
                plan.fill(slots, many)
    rest: dict[int, int] = {n: c for n, c in histogram.items() if n <= small}
    for g in merged.values():
        for n, c in g:
            if c:
                rest[n] = rest.get(n, 0) + c
    for n in sorted(rest, reverse=True):
        plan.best_fit(n, rest[n])
    return plan


def _take(group: list[list[int]], count: int) -> list[list[int]]:
    out = []
    while count and group:
        k = min(count, group[0][1])
        if k:
            out.append([group[0][0], k])
        group[0][1] -= k
        count -= k
        if not group[0][1]:
            group.pop(0)
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces with doc_id, piece, length (1 to capacity) -> the same rows and columns with
    sequence_id and offset. No piece: no row. Repeated rows are packed as often as they come."""
    spark = pieces.sparkSession
    shares = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)).cast("int"))
    counts = materialise(dealt.groupBy("length", "share").count(), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    plan = plan_packing(histogram, capacity)
    runs = spark.createDataFrame(plan.runs, "length long, a long, n long, seq long, per long, at long")
    before = counts.select("length", "share", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, ["length", "share"]).withColumn("k", F.col("k") - 1 + F.col("before"))
    # the plan's size depends on the capacity alone
    runs = F.broadcast(runs) if len(plan.runs) <= 64 * capacity else runs
    placed = ranked.join(runs, "length").where("k >= a and k < a + n")
    k = F.col("k") - F.col("a")
    return placed.select(*pieces.columns, (F.col("seq") + F.floor(k / F.col("per"))).alias("sequence_id"), (F.col("at") + k % F.col("per") * F.col("length")).alias("offset"))
