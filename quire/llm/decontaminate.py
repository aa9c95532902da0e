"""Benchmark decontamination by size-partitioned MinHash containment search (operator 1).

Items are partitioned by their number of shingles: at most 8, 16, 32, 64 ... Whole documents are far larger than items, so that
their similarity tells nothing; for the class of at most u shingles, a document is cut into windows of 2u successive shingles,
a new one every u, so that any u successive shingles lie in one window. A containment of t of an item of more than u/2
shingles means a similarity to the window of at least 0.5 t / (2 + 0.5 (1 - t)); bands of one row are chosen for that
bound, as many as make a miss a matter of one in a million. Windows of all classes are put together from the least hashes of
blocks of 8 shingles. For items of at most 8 shingles the window is one shingle, and the search is exact.

A document that shares a band with an item is a candidate; the share of the item's distinct shingles that the whole document
has, counted exactly, decides. The index of the items is sent to the tasks in blocks of a bounded number of items; a pass over the rows
searches ten of them (200,000 items) with hashes and windows made once. Documents never leave their task.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.shingles import U, odd_numbers, shingles, word_hashes

WIDTH, SMALL, MISS = 5, 8, 1e-6
#: Items in one broadcast index, about 1 KB each, and indexes that one pass over the documents searches.
ITEMS, BLOCKS = 20_000, 10


def bands(threshold: float) -> int:
    """Bands of one row for the least similarity of a window to an item that it contains to the threshold."""
    least = 0.5 * threshold / (2 + 0.5 * (1 - threshold))
    return max(1, math.ceil(math.log(MISS) / math.log(1 - least)))


def windows(values: np.ndarray, family: np.ndarray, classes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(u, least hashes of the windows for class u), one column for each window."""
    n_blocks = -(-len(values) // SMALL)
    padded = np.concatenate([values, np.repeat(values[-1:], n_blocks * SMALL - len(values))]).reshape(n_blocks, SMALL).T.copy()
    least = family[:, None] * padded[0]
    for row in padded[1:]:
        np.minimum(least, family[:, None] * row, out=least)
    u, step = SMALL, least  # columns of step: runs of u shingles
    for wanted in classes:
        while u < wanted:
            if step.shape[1] > 1:
                even = step.shape[1] // 2 * 2
                joined = np.minimum(step[:, 0:even:2], step[:, 1:even:2])
                step = np.concatenate([joined, step[:, even:]], axis=1)
            u *= 2
        yield u, np.minimum(step[:, :-1], step[:, 1:]) if step.shape[1] > 1 else step


class Index:
    """The searchable form of one block of items."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float) -> None:
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        hashed = [word_hashes(x) for _, x in items]
        self.widths = sorted({min(WIDTH, len(x)) for x in hashed if len(x)})
        self.width_of = [min(WIDTH, len(x)) for x in hashed]
        self.sets = [np.unique(shingles(x, WIDTH)) for x in hashed]
        self.family = odd_numbers(bands(threshold), 1)
        keys: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for k, (found, width) in enumerate(zip(self.sets, self.width_of, strict=True)):
            if not len(found):
                continue
            if width < WIDTH or len(found) <= SMALL:
                u, marks = -width, found
            else:
                u, marks = 1 << (len(found) - 1).bit_length(), (self.family[:, None] * found).min(axis=1)
            keys[u][0].append(marks)
            keys[u][1].append(np.full(len(marks), k))
        self.tables = {}
        for u, (marks, owners) in keys.items():
            flat, own = np.concatenate(marks), np.concatenate(owners)
            order = np.argsort(flat, kind="stable")
            bits = 1 << max(16, (len(flat) * 16 - 1).bit_length())
            seen = np.zeros(bits, bool)
            seen[(flat & U(bits - 1)).astype(np.int64)] = True
            self.tables[u] = flat[order], own[order], seen, U(bits - 1)
        self.classes = sorted(u for u in self.tables if u > 0)

    def _owners(self, u: int, marks: np.ndarray) -> set[int]:
        flat, own, seen, mask = self.tables[u]
        marks = marks.ravel()
        marks = marks[seen[(marks & mask).astype(np.int64)]]
        if not len(marks):
            return set()
        marks = np.unique(marks)
        low, high = np.searchsorted(flat, marks, "left"), np.searchsorted(flat, marks, "right")
        return {int(own[i]) for a, b in zip(low, high, strict=True) for i in range(a, b)}



def search(indexes: list[Index], text: bytes | None) -> list[tuple[int, float]]:
    """(item id, containment) of the items that the text contains to the threshold; hashes and windows are made once for all indexes."""
    hashed = word_hashes(text)
    widths = {WIDTH}.union(*(x.widths for x in indexes))
    values = {w: shingles(hashed, w) for w in widths if len(hashed) >= w}
    found: list[set[int]] = [set() for _ in indexes]
    for index, owners in zip(indexes, found, strict=True):
        for u in index.tables:
            if u < 0 and -u in values:
                owners |= index._owners(u, values[-u])
    classes = sorted(set().union(*(x.classes for x in indexes)))
    if classes and WIDTH in values:
        for u, marks in windows(values[WIDTH], indexes[0].family, classes):
            for index, owners in zip(indexes, found, strict=True):
                if u in index.tables:
                    owners |= index._owners(u, marks)
    whole = {w: np.unique(x) for w, x in values.items()} if any(found) else {}
    out = []
    for index, owners in zip(indexes, found, strict=True):
        for k in sorted(owners):
            share = np.isin(index.sets[k], whole[index.width_of[k]], assume_unique=True).mean()
            if share >= index.threshold:
                out.append((index.ids[k], float(share)))
    return out


def _searched(indexes: list, text_at: int, hits_at: int):
    """Hits are added to those that are there. The text's own bytes are read instead of a decoded string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [x.value for x in indexes]
        for batch in batches:
            raw, before = batch.column(text_at).cast(pa.binary()), batch.column(hits_at).to_pylist()
            hits = [(old or []) + [{"item_id": i, "containment": x} for i, x in search(ready, text.as_py())] for text, old in zip(raw, before, strict=True)]
            columns = list(batch.columns)
            columns[hits_at] = pa.array(hits, pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())])))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, hits_col: str = "hits") -> DataFrame:
    """The rows of docs with a column more: the items (id, containment) that a row's text holds to the threshold.

    Containment is the share of the item's distinct shingles of five words (all its words, if fewer) that the text has.
    Null, empty and short texts have no hits unless they hold a short item; items without words are found nowhere; repeated
    items each count. Rows are neither dropped nor changed, repeated ones are searched one by one; texts are searched whole, whatever their
    length; an empty table gives no rows. A column of docs named hits_col is replaced.
    """
    spark = docs.sparkSession
    blocks = max(1, math.ceil(items.count() / ITEMS))
    dealt = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("binary").alias("x")).withColumn("block", F.pmod(F.xxhash64("i", "x"), F.lit(blocks)))
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("containment", T.DoubleType())]))
    docs = docs.drop(hits_col)
    out = docs.withColumn(hits_col, F.lit(None).cast(kind))
    names = out.columns

    def index(block: int):
        rows = dealt.where(F.col("block") == block).orderBy("i").collect()
        return spark.sparkContext.broadcast(Index([(r.i, bytes(r.x or b"")) for r in rows], threshold))

    for first in range(0, blocks, BLOCKS):
        sent = [index(k) for k in range(first, min(blocks, first + BLOCKS))]
        out = out.mapInArrow(_searched(sent, names.index(text_col), names.index(hits_col)), out.schema)
    return out
