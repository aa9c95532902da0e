"""Partitions whose number grows with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input files for one partition of work that makes many rows of a text.
SHARE = 4 << 20
#: A source that doesn't know its size says about 2^63.
UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df is made from, by the statistics of its plan; sources of unknown size count nothing. No job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(n for n in sizes if n < UNKNOWN)


def dealt(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """df by keys, in partitions of ``SHARE`` bytes of input, and as many as there are cores at least.

    Adaptive execution sizes partitions by the bytes that are shuffled. Where a row is exploded after the shuffle that leaves too few, and tasks whose sorts
    grow with the input; a number of one's own stays as it is. like: by the input of that table, to lie with what is made from it.
    """
    if df.isStreaming:
        return df.repartition(*keys)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df if like is None else like) // SHARE)), *keys)


def unsent(df: DataFrame) -> DataFrame:
    """df as a side of a join by shuffle, never by broadcast.

    Spark decides by the bytes of files; ids and flags of a written table pack to a hundredth of their rows' size in the driver's memory.
    """
    return df.hint("merge")
