"""Versions of documents: snapshots, comparison, line differences, staged commits and paged reading."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import diffs


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.octet_length(text_col).cast("long").alias("size"), F.sha2(text_col, 256).alias("sha256"))


def unchanged_skipped(docs: DataFrame, last: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only documents whose fingerprint differs from the last run's."""
    now = docs.withColumn("sha256", F.sha2(text_col, 256))
    return now.join(last.select(id_col, "sha256"), [id_col, "sha256"], "left_anti").drop("sha256")


def snapshot(docs: DataFrame, version: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (version, tag, id, sha256, text) of a checkpoint; append them to a table partitioned by version."""
    return docs.select(F.lit(version).cast("long").alias("version"), F.lit(f"V{version:04d}").alias("tag"), id_col, F.sha2(text_col, 256).alias("sha256"), text_col)


def next_version(snapshots: DataFrame) -> int:
    return (snapshots.agg(F.max("version")).first()[0] or 0) + 1


def compare(left: DataFrame, right: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, status): left_only, right_only, modified or same. Only hashes are joined, not texts."""
    a, b = (x.select(id_col, F.sha2(text_col, 256).alias(n)) for x, n in ((left, "a"), (right, "b")))
    status = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").when(F.col("a") != F.col("b"), "modified").otherwise("same")
    return a.join(b, id_col, "full").select(id_col, status.alias("status"))


def restore(snapshots: DataFrame, version: int) -> DataFrame:
    return snapshots.where(F.col("version") == version)


def diffstat(diff: DataFrame) -> DataFrame:
    """Added and removed lines per document, and totals with the number of files."""
    return diff.groupingSets([["doc_id"], []], "doc_id").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("files"), F.grouping("doc_id").cast("int").alias("is_total"))


def line_opcodes(old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, op, old_from, old_to, new_from, new_to): a shortest line difference of each changed document that both versions have.

    A null text is an empty one; a text has one line more than line ends. Ids that are repeated give every pair. Each document is compared in its row, in time by the number of
    lines and differences; texts that share no line cost nothing more.
    """
    kind = old.schema[id_col].dataType.simpleString()
    empty = F.lit("")
    a, b = old.select(id_col, F.coalesce(text_col, empty).alias("_a")), new.select(id_col, F.coalesce(text_col, empty).alias("_b"))
    return a.join(b, id_col).where("_a <> _b").mapInArrow(_opcodes, f"`{id_col}` {kind}, op string, old_from long, old_to long, new_from long, new_to long")


def _opcodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, ops = [], []
        for row, (a, b) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            found = list(diffs.opcodes(a.as_py().split("\n"), b.as_py().split("\n")))
            at += [row] * len(found)
            ops += found
        columns = list(zip(*ops, strict=True)) or [()] * 5
        kinds = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=[batch.schema.names[0], "op", "old_from", "old_to", "new_from", "new_to"])


def edit_counts(ops: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, kept, deleted, inserted) lines and n_ops (edits in one place) of each changed document."""
    old, new = F.col("old_to") - F.col("old_from"), F.col("new_to") - F.col("new_from")
    edit = F.col("op") != "equal"
    sums = [F.sum(F.when(~edit, old).otherwise(0)).alias("kept"), F.sum(F.when(edit, old).otherwise(0)).alias("deleted"), F.sum(F.when(edit, new).otherwise(0)).alias("inserted")]
    return ops.groupBy(id_col).agg(*sums, F.count_if(edit).alias("n_ops"))


def stage_commit(live: DataFrame, staged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged texts against live ones (both with a revision): status conflict if the live revision moved, missing, else ready; with lengths.

    ``apply_staged`` makes the next version of all, or of none.
    """
    a = live.select(id_col, F.col("revision").alias("live_revision"), F.length(text_col).cast("long").alias("old_length"))
    b = staged.select(id_col, F.col("base_revision"), F.length(text_col).cast("long").alias("new_length"))
    status = F.when(F.col("live_revision").isNull(), "missing").when(F.col("live_revision") != F.col("base_revision"), "conflict").otherwise("ready")
    return b.join(a, id_col, "left").select(id_col, status.alias("status"), "old_length", "new_length")


def apply_staged(live: DataFrame, staged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bad = stage_commit(live, staged, id_col, text_col).agg(F.count_if(F.col("status") != "ready").alias("_bad"))
    new = staged.select(id_col, F.col(text_col).alias("_new"))
    rows = live.join(new, id_col, "left").crossJoin(F.broadcast(bad))  # one row
    take = F.col("_new").isNotNull() & (F.col("_bad") == 0)
    return rows.withColumns({text_col: F.when(take, F.col("_new")).otherwise(F.col(text_col)), "revision": F.col("revision") + take.cast("int")}).drop("_new", "_bad")


def range_read(text: Column | str, start: int, n: int) -> tuple[Column, Column]:
    """n code points from a 0-based start, and where to go on."""
    c = T.col(text)
    return F.substring(c, start + 1, n), F.least(F.lit(start + n), F.length(c)).cast("long")


def page(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The n rows after a cursor, by key."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(n)
