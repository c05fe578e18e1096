"""Connected components of an edge table, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) undirected links -> (id, component): the smallest id reachable.

    Alternates large-star and small-star steps until nothing changes (about log2(rows)**2
    rounds at most; there is no cap); every step is a
    grouped minimum (partial sums before the shuffle) and a join back, so no
    neighbour list is ever gathered. Ids without a link are not in the result.
    Null ends and loops are ignored; an empty table gives an empty result."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    e = materialise(e, "edges")
    before = _state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct()
        )
        e = materialise(small, "edges")
        now = _state(e)
        if now == before:
            break
        before = now
    own = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return own.union(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
