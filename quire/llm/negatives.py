"""Hard-negative mining by rotated one-bit codes (operator 12).

Every vector is rotated (signs by a fixed rule and Walsh-Hadamard steps), and the signs of the rotated components are its code b, a unit vector. Stored
beside it are the alignment s = <b, y> and what is left of the length, r. An anchor z is rounded to a few bits a component, so that <b, z> is a sum
of population counts over bit planes. By Cauchy-Schwarz, <y, z> lies within r * sqrt(|z|^2 - <b, z>^2) of s * <b, z>, plus what rounding the anchor
can change: an interval without chance. Only rows whose interval reaches a wanted score are scored, in whole numbers.

Anchors go in blocks of bounded bytes over all rows, each block in two scans: one for the positives, one for the negatives that their scores allow.
Tasks pass on a few rows for each anchor; nothing is grouped by label, and no pairs are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.scratch import Scratch

#: Bits to which an anchor's rotated components are rounded.
BITS = 6
#: Bytes of anchors in a block: what the driver collects and broadcasts at once.
BLOCK_BYTES = 16_000_000
#: Anchors and rows whose intervals are held at once in a task.
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 64, 8192
#: Whole numbers below this are exact as doubles.
EXACT = 2.0**53
U = np.uint64


def rotate(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of x, filled up with zeros to ``width`` (a power of two), under one orthogonal map."""
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    for step in range(3):
        mixed = (np.arange(1, width + 1, dtype=U) + U(step * width)) * U(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> U(29))) * U(0xBF58476D1CE4E5B9)
        out *= np.where(mixed >> U(63), 1.0, -1.0)
        half = 1
        while half < width:
            pairs = out.reshape(len(x), -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
            half *= 2
        out /= np.sqrt(width)
    return out


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``dims`` 64-bit integers, with zeros where a list is shorter."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), dims), np.int64)
    out[np.arange(dims) < ends[:, None]] = flat
    return out


def codes(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits in 64-bit words, alignment, rest and length of each row."""
    y = rotate(x.astype(float), width)
    align, length = np.abs(y).sum(1) / np.sqrt(width), np.sqrt((y**2).sum(1))
    return np.packbits(y >= 0, axis=1).view(U), align, np.sqrt(np.maximum(length**2 - align**2, 0)), length


class Anchors:
    """A block of anchors: vectors, and their rotated components in bit planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, width: int) -> None:
        self.ids, self.labels, self.x, self.width = ids, labels, x, width
        z = rotate(x.astype(float), width)
        self.length = np.sqrt((z**2).sum(1))
        self.low = z.min(1)
        self.step = np.maximum((z.max(1) - self.low) / (2**BITS - 1), 1e-300)
        whole = np.rint((z - self.low[:, None]) / self.step[:, None]).clip(0, 2**BITS - 1)
        near = self.low[:, None] + self.step[:, None] * whole
        self.sum, self.square, self.error = near.sum(1), (near**2).sum(1), np.sqrt(((z - near) ** 2).sum(1))
        self.planes = np.stack([np.packbits(whole.astype(np.uint8) >> p & 1, axis=1).view(U) for p in range(BITS)], axis=1)

    def interval(self, of: np.ndarray, code: np.ndarray, align: np.ndarray, rest: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible scores of rows with the anchors ``of``."""
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        counts = np.zeros((len(of), len(code)), np.uint32)
        for p in range(BITS):
            for w in range(code.shape[1]):
                counts += np.bitwise_count(code[None, :, w] & self.planes[of, p, w, None]).astype(np.uint32) << np.uint32(p)
        dot = (2 * (self.low[of, None] * ones + self.step[of, None] * counts) - self.sum[of, None]) / np.sqrt(self.width)
        middle = align * dot
        reach = rest * np.sqrt(np.maximum(self.square[of, None] - dot**2, 0)) + length * self.error[of, None]
        reach += 1e-9 * (1 + length * self.length[of, None])  # more than floating point can lose
        return middle - reach, middle + reach


def scores(rows: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products in whole numbers: by doubles where all sums are exact, else by Python's integers."""
    return np.rint(rows.astype(float) @ anchor.astype(float)).astype(np.int64) if exact else rows.astype(object) @ anchor.astype(object)


def first(held: list, found: np.ndarray, ids: np.ndarray, k: int) -> list:
    """The k best (score, id), the higher score and then the smaller id first, from those held and found; an id counts once."""
    order = sorted(range(len(ids)), key=lambda i: (-found[i], ids[i])) if found.dtype == object else np.lexsort((ids, -found))
    new: dict[int, int] = {}
    for i in order:
        new.setdefault(int(ids[i]), int(found[i]))
        if len(new) == k:
            break
    for score, i in held:
        new[i] = max(score, new.get(i, score))
    return sorted(((s, i) for i, s in new.items()), key=lambda x: (-x[0], x[1]))[:k]


def as_long(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


class Batch:
    """A batch of the code table."""

    def __init__(self, batch: pa.RecordBatch, dims: int) -> None:
        get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.ids, self.labels, self.x = get["id"].to_numpy(), get["label"].to_numpy(), matrix(get["vector"], dims)
        words = np.frombuffer(b"".join(get["code"].to_pylist()), U)
        self.code = words.reshape(len(self.ids), -1)
        self.align, self.rest, self.length = (get[c].to_numpy() for c in ("align", "rest", "length"))

    def interval(self, anchors: Anchors, of: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return anchors.interval(of, self.code[rows], self.align[rows], self.rest[rows], self.length[rows])


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Batch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield Batch(batch.slice(at, ROWS_AT_ONCE), dims)


def _positives(sent, dims: int, k: int):
    """For each anchor the k best other rows of its label in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Anchors = sent.value
        held: list[list] = [[] for _ in a.ids]
        least = np.full(len(a.ids), -np.inf)
        for b in _parts(batches, dims):
            for label in np.intersect1d(a.labels, b.labels):
                rows, same = np.flatnonzero(b.labels == label), np.flatnonzero(a.labels == label)
                for at in range(0, len(same), ANCHORS_AT_ONCE):
                    of = same[at : at + ANCHORS_AT_ONCE]
                    _, high = b.interval(a, of, rows)
                    for i, may in zip(of, high >= least[of, None], strict=True):
                        own = rows[may]
                        own = own[b.ids[own] != a.ids[i]]
                        if len(own):
                            found = scores(b.x[own], a.x[i], b.length.max() * a.length.max() < EXACT)
                            held[i] = first(held[i], found, b.ids[own], k)
                            least[i] = held[i][-1][0] if len(held[i]) == k else -np.inf
        out = [(int(i), row, as_long(score)) for i, x in zip(a.ids, held, strict=True) for score, row in x]
        yield pa.RecordBatch.from_pylist([dict(zip(("anchor_id", "positive_id", "positive_score"), x, strict=True)) for x in out], POSITIVE)

    return run


POSITIVE = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score")])
NEGATIVE = pa.schema([*POSITIVE, ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _negatives(sent, dims: int, k: int, low: int, high: int):
    """For each anchor and positive the k best rows of another label in this task whose score is in the positive's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, positives = sent.value
        most = max([1, *map(len, positives)])
        held = [[[] for _ in x] for x in positives]
        least, upper = np.full((len(a.ids), most), np.inf), np.full((len(a.ids), most), -np.inf)
        ranges = [[(-(-low * s // 100), high * s // 100) for _, s in x] for x in positives]
        for i, x in enumerate(ranges):
            for p, (l, u) in enumerate(x):
                least[i, p], upper[i, p] = l, u
        for b in _parts(batches, dims):
            every = np.arange(len(b.ids))
            for at in range(0, len(a.ids), ANCHORS_AT_ONCE):
                of = np.arange(at, min(at + ANCHORS_AT_ONCE, len(a.ids)))
                under, over = b.interval(a, of, every)
                may = np.zeros(under.shape, bool)
                for p in range(most):
                    may |= (over >= least[of, p, None]) & (under <= upper[of, p, None])
                may &= b.labels != a.labels[of, None]
                for i, x in zip(of, may, strict=True):
                    own = np.flatnonzero(x)
                    if not len(own):
                        continue
                    found = scores(b.x[own], a.x[i], b.length.max() * a.length.max() < EXACT)
                    for p, (l, u) in enumerate(ranges[i]):
                        fits = np.flatnonzero((found >= max(l, held[i][p][-1][0] if len(held[i][p]) == k else l)) & (found <= u))
                        if len(fits):
                            held[i][p] = first(held[i][p], found[fits], b.ids[own[fits]], k)
                            if len(held[i][p]) == k:
                                least[i, p] = held[i][p][-1][0]
        out = [
            (int(i), row, score, negative, as_long(s))
            for i, x, lists in zip(a.ids, positives, held, strict=True)
            for (row, score), found in zip(x, lists, strict=True)
            for s, negative in found
        ]
        yield pa.RecordBatch.from_pylist([dict(zip(NEGATIVE.names, x, strict=True)) for x in out], NEGATIVE)

    return run


def _codes(dims: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                code, align, rest, length = codes(matrix(part.column(3), dims), width)
                more = [pa.array([x.tobytes() for x in code], pa.binary()), *map(pa.array, (align, rest, length))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "code", "align", "rest", "length"])

    return run


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row of ``anchors``.

    Vectors are lists of whole numbers (long), labels whole numbers; a score is an inner product. An anchor's positives are the first rows of its label and another
    id, by score and then smaller id; for each of them the first rows of another label follow whose score is from low to high per cent of the positive's.

    Rows with a null id, label, vector or component take no part. A shorter vector counts as filled up with zeros. Of rows that share an id the best one counts, of anchors
    that do the one with the least label and vector. Scores beyond the range of long are compared whole and shown as its end; a range follows from the shown score. Other
    columns are not read. An empty table, or one without anchors, gives no rows.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "negatives")
    id_, label, vector = F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.col(vector_col).cast("array<long>")
    whole = id_.isNotNull() & label.isNotNull() & vector.isNotNull() & ~F.exists(F.coalesce(vector, F.array().cast("array<long>")), lambda x: x.isNull())
    taken = rows.where(whole).select(id_.alias("id"), label.alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), vector.alias("vector"))
    size = taken.agg(F.max(F.size("vector")).alias("dims"), F.count_if("anchor").alias("anchors")).first()
    dims = size.dims or 1
    width = max(64, 1 << (dims - 1).bit_length())
    table = scratch.table(taken.mapInArrow(_codes(dims, width), "id long, label long, anchor boolean, vector array<long>, code binary, align double, rest double, length double"), "codes")
    # blocks by a hash of the id; 8 bytes of each number and BITS bits of each rotated component
    blocks = -(-size.anchors * (8 * dims + 2 * width + 64) // BLOCK_BYTES)
    one = table.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("one")).select("id", "one.label", "one.vector")
    asked = scratch.table(one.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks)))).repartition(F.col("block")), "anchors")
    ranked = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    parts = []
    for block in range(blocks):
        got = asked.where(F.col("block") == block).toArrow()
        if not got.num_rows:
            continue
        a = Anchors(got["id"].to_numpy(), got["label"].to_numpy(), matrix(got["vector"], dims), width)
        sent = spark.sparkContext.broadcast(a)
        found = table.mapInArrow(_positives(sent, dims, positives), "anchor_id long, positive_id long, positive_score long")
        found = found.groupBy("anchor_id", "positive_id").agg(F.max("positive_score").alias("positive_score")).withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= positives)
        by_id: dict[int, list] = {}
        for x in found.select("anchor_id", "positive_id", "positive_score", "n").toArrow().sort_by([("anchor_id", "ascending"), ("n", "ascending")]).to_pylist():
            by_id.setdefault(x["anchor_id"], []).append((x["positive_id"], x["positive_score"]))
        both = spark.sparkContext.broadcast((a, [by_id.get(int(i), []) for i in a.ids]))
        mined = table.mapInArrow(_negatives(both, dims, negatives, low, high), ", ".join(f"{c} long" for c in NEGATIVE.names))
        parts.append(scratch.table(_ranked(mined, negatives), f"block-{block}"))
        sent.destroy()
        both.destroy()
    scratch.keep(*(f"block-{i}" for i in range(blocks)))
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return none if not parts else spark.read.schema(none.schema).parquet(*(f"{scratch.at}/block-{i}" for i in range(blocks) if f"block-{i}" in scratch.made))


def _ranked(mined: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    best = mined.groupBy("anchor_id", "positive_id", "positive_score", "negative_id").agg(F.max("negative_score").alias("negative_score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
