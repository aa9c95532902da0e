"""Packing token sequences (operator 3).

A document's ids are cut into full windows and one rest. The histogram of the rests' lengths (at most window - 1 numbers) is
fitted by non-negative least squares with combinations of two or three lengths that fill a window exactly; the repeat counts
are rounded down and what is left is packed greedily: first by the same combinations, then by filling windows one after
another, where a rest is cut at the window's end. A rest's place follows from its rank among rests of its length, which tasks
count locally and a table of offsets makes global, so nothing is collected but the histogram.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.plans.scratch import Scratch

#: Pre-tokens in each of a worker's two caches, and rows of the offset table up to which it is broadcast (24 bytes each).
CACHE, BROADCAST_ROWS = 300_000, 500_000
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Cuts only where the byte-level pattern cuts: a run of letters, or anything up to the next white space, or white space.
CUT = re.compile(rf" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\W\d_])|[{SPACE}]?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")


class ByteSigns(dict):
    """A character's UTF-8 bytes as the signs that byte-level vocabularies are written in: printable Latin-1 as it is, others from U+0100 on."""

    def __init__(self) -> None:
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(256, 512))
        self.of = [chr(b) if b in plain else chr(next(others)) for b in range(256)]

    def __missing__(self, point: int) -> str:
        out = self[point] = "".join(self.of[b] for b in chr(point).encode())
        return out


BYTE_SIGNS = ByteSigns()


class Kept(dict):
    """Ids of pre-tokens, encoded when they are first asked for; a full table becomes the old one, from which what occurs again is taken over."""

    def __init__(self, library: Tokenizer) -> None:
        super().__init__()
        self.library, self.merges, self.old = library, library.model, {}

    def __missing__(self, x: str) -> bytes:
        ids = self.old.get(x)
        if ids is None:
            if x.isalpha() or x[0] == " " and x[1:].isalpha():  # one pre-token: straight to the merges
                ids = packed([t.id for t in self.merges.tokenize(x.translate(BYTE_SIGNS))])
            else:
                ids = packed(self.library.encode(x, add_special_tokens=False).ids)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[x] = ids
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library; pre-tokens are encoded once and kept."""

    def __init__(self, spec: str) -> None:
        self.library, told = Tokenizer.from_str(spec), json.loads(spec)
        pre = told.get("pre_tokenizer") or {}
        self.cuts = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        self.kept = Kept(self.library)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if self.cuts and not any(x in text for x in self.special):
                yield b"".join(map(self.kept.__getitem__, CUT.findall(text)))
            else:
                yield packed(self.library.encode(text, add_special_tokens=False).ids)


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(2)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


def _encoded(spec: str, window: int, end: int | None):
    """Ids of each text, and the ranks of its full windows and of its rest among those of the task."""
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, full_rank, rest_ranks = TaskContext.get().partitionId(), 0, defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [np.frombuffer(x + tail, "<u4") for x in encoder(spec).encode(part.column(1).to_pylist())]
                out: tuple[list, ...] = ([], [], [], [], [])
                for x in ids:
                    full, rest = divmod(len(x), window)
                    for values, y in zip(out, (pid, full, full_rank, rest, rest_ranks[rest]), strict=True):
                        values.append(y)
                    full_rank += full
                    rest_ranks[rest] += 1
                # two bytes an id on disk where that is enough
                kept = [x.astype("<u2").tobytes() if not len(x) or x.max() < 65536 else b"+" + x.tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in out)], names=["id", "ids", "pid", "full", "full_rank", "rest", "rest_rank"])

    return run


def plan(histogram: np.ndarray, window: int, rounds: int = 150) -> list[tuple[int, ...]]:
    """(repeats, lengths...) of combinations of 2 and 3 lengths that sum to the window. histogram: rests by length."""
    present = np.flatnonzero(histogram[1:window]) + 1
    if not len(present):
        return []
    there = np.zeros(window + 1, bool)
    there[present] = True
    a, b = (x.ravel() for x in np.meshgrid(present, present, indexing="ij"))
    pairs = np.stack([a, b], 1)[(a <= b) & (a + b == window)]
    c = window - a - b
    keep = (a <= b) & (b <= c)
    triples = np.stack([a, b, c], 1)[keep]
    triples = triples[there[triples[:, 2]]]
    ways = [pairs, triples]
    goal = histogram.astype(float)
    weights = [np.ones(len(x)) for x in ways]
    for _ in range(rounds):  # multiplicative steps keep the counts non-negative and never raise the squared error
        used = sum(np.bincount(w.ravel(), np.repeat(x, w.shape[1]), window + 1) for w, x in zip(ways, weights, strict=True))
        weights = [x * goal[w].sum(1) / np.maximum(used[w].sum(1), 1e-9) for w, x in zip(ways, weights, strict=True)]
    left, chosen = histogram.astype(np.int64).copy(), defaultdict(int)
    order = sorted(((x, tuple(map(int, w))) for ws, xs in zip(ways, weights, strict=True) for w, x in zip(ws, xs, strict=True)), reverse=True)
    for greedy in (False, True):
        for x, lengths in order:
            most = min(left[y] // lengths.count(y) for y in lengths)
            n = int(most if greedy else min(int(x), most))
            if n > 0:
                chosen[lengths] += n
                for y in lengths:
                    left[y] -= n
    return [(n, *lengths) for lengths, n in chosen.items()]


def _slots(histogram: np.ndarray, window: int):
    """For each length: first ranks, sequences and offsets of its slots; where its unplanned rests start; sequences so far."""
    slots, taken, sequences = defaultdict(lambda: ([], [], [])), np.zeros(window + 1, np.int64), 0
    for n, *lengths in plan(histogram, window):
        offset = 0
        for x in lengths:
            for values, y in zip(slots[x], (taken[x], sequences, offset), strict=True):
                values.append(y)
            taken[x] += n
            offset += x
        sequences += n
    left = (histogram - taken) * np.arange(window + 1)
    starts = np.r_[0, np.cumsum(left)[:-1]]
    tables = {x: tuple(np.array(y, np.int64) for y in v) for x, v in slots.items()}
    return tables, taken, starts, sequences, sequences + -(-int(left.sum()) // window)


def _placed(window: int, placed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, taken, starts, planned, filled = placed.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: tuple[list, ...] = ([], [], [], [], [], [], [])

                def put(i, ids, start, length, sequence, offset, out=out):
                    for values, x in zip(out, (i, start, length, ids[start : start + length].tobytes(), len(ids), sequence, offset), strict=True):
                        values.append(x)

                for i, raw, full, full_rank, rest, rest_rank in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                    ids = (np.frombuffer(raw[1:], "<u4") if len(raw) % 2 else np.frombuffer(raw, "<u2")).astype("<u4")
                    for k in range(full):
                        put(i, ids, k * window, window, filled + full_rank + k, 0)
                    if not rest:
                        continue
                    if rest_rank < taken[rest]:
                        ranks, sequences, offsets = slots[rest]
                        k = np.searchsorted(ranks, rest_rank, "right") - 1
                        put(i, ids, full * window, rest, int(sequences[k] + rest_rank - ranks[k]), int(offsets[k]))
                    else:
                        place = int(starts[rest] + (rest_rank - taken[rest]) * rest)
                        room = min(rest, window - place % window)
                        put(i, ids, full * window, room, planned + place // window, place % window)
                        if room < rest:
                            put(i, ids, full * window + room, rest - room, planned + place // window + 1, 0)
                kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end: int | None = 0) -> DataFrame:
    """Pieces of all texts in sequences of at most ``window`` ids, each id in exactly one piece.

    Returns id, start and length of the piece in its document, ids (unsigned little-endian 32-bit numbers), doc_tokens,
    sequence_id and offset there (gapless from 0). All sequences are full but the last of the rests. ``end``: an id put
    after each text. A null text is an empty one; repeated or null ids keep their own pieces. An empty table gives no rows.
    """
    spark, spec = docs.sparkSession, open(tokenizer_path, encoding="utf-8").read()
    scratch = Scratch(spark, "packing")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    encoded = scratch.table(texts.mapInArrow(_encoded(spec, window, end), "id long, ids binary, pid long, full long, full_rank long, rest long, rest_rank long"), "encoded")
    by_task = encoded.groupBy("pid", F.col("rest").alias("length")).agg(F.count("*").alias("n")).unionByName(encoded.groupBy("pid").agg(F.lit(window).cast("long").alias("length"), F.sum("full").alias("n")))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.table(by_task.select("pid", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    histogram = np.zeros(window + 1, np.int64)
    for x in offsets.where(f"length between 1 and {window - 1}").groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[x.length] = x.n
    small = offsets.count() <= BROADCAST_ROWS
    sent = F.broadcast if small else lambda x: x
    rests = offsets.select("pid", F.col("length").alias("rest"), F.col("before").alias("rest_before"))
    fulls = offsets.where(f"length = {window}").select("pid", F.col("before").alias("full_before"))
    ranked = (
        encoded.join(sent(rests), ["pid", "rest"])
        .join(sent(fulls), "pid")
        .select("id", "ids", "full", (F.col("full_rank") + F.col("full_before")).alias("full_rank"), "rest", (F.col("rest_rank") + F.col("rest_before")).alias("rest_rank"))
    )
    placed = spark.sparkContext.broadcast(_slots(histogram, window))
    kinds = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(window, placed), kinds).withColumnRenamed("id", id_col)
