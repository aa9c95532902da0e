"""Connected components by alternating large-star and small-star steps, each a Spark job over a written table.

A node with very many edges, a hub, is no single task's work: the least neighbour of each node is a grouped minimum, which Spark
forms before it shuffles. To hand it back, the minima are broadcast while they are few; beyond that they are written first, so
that the join reads two plain shuffles, whose skewed partitions Spark splits (adaptive skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.scratch import Scratch

#: Rows up to which their minima are broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000


def with_least(rows: DataFrame, key: str, value: str, n_rows: int, scratch: Scratch, name: str) -> DataFrame:
    """rows, n_rows at most, with a column m: the least value of their key."""
    least = rows.groupBy(key).agg(F.min(value).alias("m"))
    return rows.join(F.broadcast(least) if n_rows <= BROADCAST_ROWS else scratch.table(least, name), key)


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Edges (a, b) to (node, root), root the least node that can be reached; roots themselves have no row.

    Edges may repeat, point either way or to themselves. No edges: no rows. Ids must not be null.
    """
    now = scratch.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    before, step = None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if tuple(seen) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, step, n = tuple(seen), step + 1, 2 * seen[0]
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = with_least(both, "u", "v", n, scratch, f"{name}-{step}-large").where("v > u")
        large = near.select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        if n > BROADCAST_ROWS:
            large = scratch.table(large, f"{name}-{step}-stars")
        near = with_least(large, "a", "b", n, scratch, f"{name}-{step}-small")
        small = near.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        following = scratch.table(small.where("a <> b").distinct(), f"{name}-{step}")
        for old in (f"{name}-{step - 1}", f"{name}-{step}-large", f"{name}-{step}-stars", f"{name}-{step}-small"):
            scratch.drop(old)
        now = following
