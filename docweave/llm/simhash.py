"""SimHash fingerprints and search by permuted block tables [DataFrame functions only].

Terms are runs of three lower-case words, weighted by how often they occur; each term's
64-bit hash votes on 64 signed bits. The votes are summed two to a long, so a text of n terms
costs n rows of 32 sums that Spark adds up before anything is shuffled.

Search: a fingerprint is cut into radius + 1 blocks; two within the radius agree in one
block at least, so one table for each block, joined on the block's value, finds every
pair. Equal fingerprints are one entry with a count, so copies are never paired.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

WORDS = 3
_LANES = 0x0000000100000001


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fp (long): the fingerprint of column text of each row; keys tell rows apart."""
    words = texts.select(*keys, F.filter(F.split(F.lower("text"), r"\s+", -1), lambda x: x != "").alias("w"))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - WORDS), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WORDS))))
    each = words.select(*keys, F.explode(F.when(F.size("w") >= WORDS, runs).otherwise(F.array(F.xxhash64(F.array_join("w", " "))))).alias("h"))
    sums = [F.sum(F.shiftright("h", j).bitwiseAND(F.lit(_LANES))).alias(f"s{j}") for j in range(32)]
    votes = each.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    bits = [F.when(F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("n"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(32)]
    bits += [F.when(F.shiftright(f"s{j}", 32) * 2 > F.col("n"), F.lit((1 << (j + 32)) - (1 << 64) * (j == 31))).otherwise(F.lit(0)) for j in range(32)]
    return votes.select(*keys, reduce(lambda a, b: a.bitwiseOR(b.cast("long")), bits[1:], bits[0].cast("long")).alias("fp"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def within_radius(queries: DataFrame, entries: DataFrame, radius: int = 3) -> DataFrame:
    """queries (fp), entries (fp, n) -> (fp, near): sum of n over entries within radius of each
    distinct query, by radius + 1 block tables. Null fingerprints match nothing."""
    width = 64 // (radius + 1)
    size = [width] * radius + [64 - width * radius]
    block = lambda c, k: F.shiftrightunsigned(c, k * width).bitwiseAND(F.lit((1 << size[k]) - 1))
    tables = F.array(*(F.struct(F.lit(k).alias("k"), block(F.col("fp"), k).alias("value")) for k in range(radius + 1)))
    q = queries.select("fp").distinct().select(F.col("fp").alias("q"), F.explode(tables).alias("b"))
    e = entries.groupBy("fp").agg(F.sum("n").alias("n")).select("fp", "n", F.explode(tables).alias("b"))
    both = q.join(e, "b").where(distance(F.col("q"), F.col("fp")) <= radius)
    x = F.col("q").bitwiseXOR(F.col("fp"))
    first = reduce(lambda c, k: c.when(block(x, k) == 0, F.lit(k)), range(1, radius + 1), F.when(block(x, 0) == 0, F.lit(0)))
    return both.where(F.col("b.k") == first).groupBy(F.col("q").alias("fp")).agg(F.sum("n").alias("near"))


_LOW = -(1 << 63)


def _place(k: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most k, in two steps of about sqrt(len(cuts)) comparisons."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    count = lambda xs: F.size(F.filter(xs, lambda c: k >= c))
    group = count(F.array(*(F.lit(g[0]) for g in groups)))
    return F.when(group == 0, 0).otherwise((group - 1) * step + count(F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group - 1)))


def with_next(docs: DataFrame, shares: int) -> DataFrame:
    """doc_id, text (null: empty), row (unique), next_row and next_text: of the next row in
    ascending doc_id (nulls first, equal ids in the order of their texts' hashes), after the last
    the first. Rows are dealt to shares of the ids, whose bounds come from quantiles; the first
    rows of each share also go to the share before, so no window spans all rows."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = own.select(F.col("k"))
    cuts = sorted({int(x) for x in ids.approxQuantile("k", [i / shares for i in range(1, shares)], 0.2 / shares)}) if shares > 1 else []
    share = _place(F.col("k"), cuts)
    firsts = ids.groupBy(share.alias("own")).agg(F.min("k").alias("k"))
    of = sorted((r[0], r[1]) for r in firsts.collect())  # at most `shares` rows
    before = [(k, of[n - 1][0]) for n, (_, k) in enumerate(of)]
    ghosts = own.sparkSession.createDataFrame(before, "k long, to int")
    # a ghost is the second copy, even where a share is its own neighbour
    copies = F.when(F.col("to").isNull(), F.array("share")).otherwise(F.array("share", "to"))
    dealt = own.withColumn("share", share).join(F.broadcast(ghosts), "k", "left").select("k", "text", "share", F.posexplode(copies).alias("is_ghost", "at"))
    w = Window.partitionBy("at").orderBy("is_ghost", "k", F.xxhash64("text"))
    one = lambda s, n: s.cast("long") * F.lit(1 << 40) + n
    out = dealt.withColumn("n", F.row_number().over(w)).withColumn("after", F.lead(F.struct("text", "share", "is_ghost")).over(w)).where("is_ghost = 0")
    return out.select(F.when(F.col("k") != _LOW, F.col("k")).alias("doc_id"), "text", one(F.col("at"), F.col("n")).alias("row"), F.col("after.text").alias("next_text"),
        F.when(F.col("after.is_ghost") == 1, one(F.col("after.share"), F.lit(1))).otherwise(one(F.col("at"), F.col("n") + 1)).alias("next_row"))


def fingerprint_report(docs: DataFrame, share: float = 0.25, radius: int = 3, every: int = 100) -> DataFrame:
    """For each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and for ids divisible by every n_within: the other rows whose
    fingerprint is within radius.

    The edited text has its last share of code points replaced by the first as many (or all) of
    the next row's text. Null text counts as empty; a single row is its own next. Repeated rows
    come out as often as they come in. Likeness is 1 minus the share of differing bits."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, max(16, 2 * parts))
    n = F.length("text")
    cut = F.floor(n * share).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    about = materialise(rows.select("row", "next_row", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")), "rows")
    both = rows.select("row", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("x")).select("row", "x.which", "x.text")
    fps = fingerprints(both, ["row", "which"])
    fps = materialise(fps.groupBy("row").agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp")), "fingerprints")
    out = about.join(fps, "row").join(fps.select(F.col("row").alias("next_row"), F.col("fp").alias("next_fp")), "next_row")
    near = within_radius(out.where(F.col("doc_id") % every == 0).select("fp"), fps.select("fp", F.lit(1).alias("n")), radius)
    out = out.join(near, "fp", "left")
    alike = lambda b: 1 - distance(F.col("fp"), F.col(b)) / 64
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select("doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), alike("edited_fp").alias("near_edited"), alike("next_fp").alias("near_next"), F.when(F.col("doc_id") % every == 0, F.col("near") - 1).alias("n_within"))
