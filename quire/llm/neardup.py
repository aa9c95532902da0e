"""MinHash near-duplicates with odd sketches (operator 9).

1. One pass hashes each text's shingles and makes 192 MinHash samples, cut into 32 bands of 6, and an odd sketch: a bitmap of
   512 parities of the hashed samples. Documents with the same shingle set are one representative from then on.
2. Rows of a band bucket stream past. Each is held against the bucket's leaders by the population count of the XOR of the odd
   sketches and tied to all leaders that may be similar; if none is close, it becomes a leader. So a bucket of any size gives
   about one row a member, never its pairs. All rows of a hot bucket are tied to its first one, by a grouped minimum instead of
   one task. The ties' components are coarse clusters: they hold all links.
3. A coarse cluster is dealt into blocks of bounded rows and shingles; each block, with the cluster's first member, is compared
   in itself: odd sketches first, then the full shingle sets with integer arithmetic. Only what is then outside of
   the cluster's largest component is held against the other blocks. So close copies cost one pass whatever their number. A task emits
   only links that join what it has not joined yet.
4. Components of the confirmed links.

A pair at the threshold of 0.85 shares no band with probability (1 - 0.85**6)**32 = 2e-7. Sketches estimate a similarity with a
standard deviation of 0.03 at 0.85, of 0.04 at 0.75 and of 0.06 at 0.5. A link is confirmed from an estimate of 0.2 below the threshold,
so a pair is missed there with less than 1e-9. Where a row has a leader (estimate of SAME or more), rows linked with it are,
by the triangle inequality, at least 0.6 similar to the leader; TIE is five standard deviations below that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected_components, with_least
from quire.llm.shingles import U, minhashes, mix, odd_numbers, shingles, word_hashes
from quire.plans.scratch import Scratch

BANDS, ROWS, BITS = 32, 6, 512
SAMPLES = BANDS * ROWS
#: Estimated similarity from which a row is tied to a leader, and from which it needs no place as a leader of its own.
TIE, SAME = 0.3, 0.75
#: Estimated similarity below the threshold from which sets are compared.
SLACK = 0.2
#: Rows of a bucket from about which it is hot, told by those of one in SHARE representatives.
HOT, SHARE = 8192, 16
#: Documents and shingles in a block, and ids in a list up to which it is broadcast (16 bytes each at most).
BLOCK, SHINGLES, BROADCAST_IDS = 512, 4_000_000, 1_000_000
#: Rows with sketches up to which they are broadcast (about 150 bytes each).
BROADCAST_ROWS = 200_000
_family, _band_weights, _sample_salts = odd_numbers(SAMPLES, 9), odd_numbers(ROWS, 19), odd_numbers(SAMPLES, 29)


def sketch(samples: np.ndarray) -> np.ndarray:
    """The odd sketch: each sample flips one bit."""
    flips = np.bincount((mix(samples + _sample_salts) & U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(U)


#: Similarity by the number of bits in which two odd sketches differ.
_by_bits = np.array(
    [1 + np.log(max(1 - 2 * min(x / BITS, 0.4999), 1e-9)) / (-2 * SAMPLES * np.log(1 - 2 / BITS)) for x in range(BITS + 1)]
)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of two odd sketches (last axis: 64-bit words)."""
    return _by_bits[np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)]


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns id, text and further ones that stay."""
    for batch in batches:
        ids, out = batch.column(0), ([], [], [], [])
        for i, text in zip(ids, batch.column(1), strict=True):
            found = np.unique(shingles(word_hashes(text.as_py())))
            if len(found):
                samples = minhashes(found, _family)
                bands = mix((samples.reshape(BANDS, ROWS) * _band_weights).sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U)).view(np.int64)
                row = len(found), _digest(found), bands, sketch(samples).tobytes()
            else:
                row = 0, f"no words {i.as_py()}".encode(), np.empty(0, np.int64), b""
            for values, x in zip(out, row, strict=True):
                values.append(x)
        kinds = pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()
        columns = [ids, *(pa.array(x, k) for x, k in zip(out, kinds, strict=True)), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "digest", "bands", "sketch", *batch.schema.names[2:]])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, digest and further ones; rows whose text has that digest, with the set instead of the text."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            sets = [np.unique(shingles(word_hashes(x.as_py()))) for x in batch.column(0)]
            right = pa.array([_digest(x) == y.as_py() for x, y in zip(sets, batch.column(1), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array([x.tobytes() for x in sets], pa.binary())], names=[*batch.schema.names[2:], "set"])
            yield out.filter(right)


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, rep, sketch) sorted by key: pairs (member, leader) of each bucket.

    Leaders that a member ties together count as one from then on, so that each row and each leader gives one pair at most.
    """
    last, leaders, joined, marks = None, [], np.empty(0, np.int64), np.empty((0, BITS // 64), U)
    for batch in batches:
        keys, reps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(keys):
            continue
        marked = np.frombuffer(b"".join(batch.column(2).to_pylist()), U).reshape(-1, BITS // 64)
        firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[firsts[1:], len(keys)]
        a, b = [], []
        for i, end in zip(firsts, ends, strict=True):
            if keys[i] != last:
                last, leaders, joined, marks = keys[i], [reps[i]], np.zeros(1, np.int64), marked[i : i + 1]
                i += 1
            for j in range(i, end):
                near = similarity(marks, marked[j])
                groups = np.unique(joined[near >= TIE])
                for k in groups[1:]:  # a group is called by its first leader
                    a.append(leaders[k])
                    b.append(leaders[groups[0]])
                    joined[joined == k] = groups[0]
                if len(groups):
                    a.append(reps[j])
                    b.append(leaders[groups[0]])
                if near.max() < SAME:
                    joined = np.append(joined, groups[0] if len(groups) else len(leaders))
                    leaders.append(reps[j])
                    marks = np.vstack([marks, marked[j : j + 1]])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _confirm(percent: int):
    """A function of rows (rep, comp, side, sketch, set): new links between rows of side 0, or of side -1 and side 1, of unlike comp."""

    def links(table: pa.Table) -> pa.Table:
        reps, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        sets = [np.frombuffer(x, U) for x in table.column("set").to_pylist()]
        marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), U).reshape(len(reps), -1)
        sizes, label = np.array([len(x) for x in sets]), table.column("comp").to_numpy().copy()
        within = not side.any()
        lower, upper = (np.arange(len(reps)),) * 2 if within else (np.flatnonzero(side == -1), np.flatnonzero(side == 1))
        out: tuple[list, list] = ([], [])
        for i in lower:
            others = upper[i + 1 :] if within else upper
            others = others[label[others] != label[i]]
            low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            others = others[100 * low >= percent * high]
            near = similarity(marks[others], marks[i])
            others, near = others[near >= percent / 100 - SLACK], near[near >= percent / 100 - SLACK]
            for j in others[np.argsort(-near, kind="stable")]:
                if label[i] == label[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    label[label == label[j]] = label[i]
                    out[0].append(reps[i])
                    out[1].append(reps[j])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return links


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """Clusters of rows (cluster, n) with the number of blocks that bounds the rows and shingles of each."""
    return rows.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES)).alias(name))


def _small(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= most else df


def _parts(df: DataFrame) -> int:
    """Partitions for rows that need much more work than their bytes tell."""
    return max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _tied(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of representatives whose components hold all links."""
    buckets = reps.select(F.explode("bands").alias("key"), "rep", "sketch")
    told = reps.where(F.pmod(F.xxhash64("rep"), F.lit(SHARE)) == 0).select(F.explode("bands").alias("key"))
    hot = scratch.table(told.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT // SHARE).select("key"), "hot")
    stars = None
    if not hot.isEmpty():
        sent = _small(hot)
        within = scratch.table(buckets.select("key", "rep").join(sent, "key"), "in-hot")
        stars = with_least(within, "key", "rep", within.count(), scratch, "least").select(F.col("rep").alias("a"), F.col("m").alias("b"))
        buckets = buckets.join(sent, "key", "left_anti")
    ties = buckets.repartition(_parts(reps), "key").sortWithinPartitions("key").mapInArrow(_ties, "a long, b long")
    ties = scratch.table((ties.unionByName(stars) if stars else ties).where("a <> b").distinct(), "ties")
    for name in ("hot", "in-hot", "least"):
        scratch.drop(name)
    return ties


def _linked(texts: DataFrame, clusters: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Confirmed links (a, b) that join what is linked; clusters: (cluster, rep, n, id, digest, sketch)."""
    names = ["cluster", "low", "high", "rep", "comp", "side", "sketch", "set"]
    of_rows = "cluster long, rep long, comp long, sketch binary, n_blocks long, n_rest long, main long, set binary"
    own = F.pmod(F.xxhash64("rep"), F.col("n_blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)

    def with_sets(rows: DataFrame) -> DataFrame:
        """The sets are made anew from the texts, which move at most once."""
        told = texts.join(_small(rows, BROADCAST_ROWS), "id").select("text", "digest", *(x.split()[0] for x in of_rows.split(", ")[:-1]))
        return told.mapInArrow(_with_sets, of_rows)

    def confirmed(dealt: DataFrame, name: str) -> DataFrame:
        spread = dealt.select(names).repartition(_parts(texts), "cluster", "low", "high")
        return scratch.table(spread.groupBy("cluster", "low", "high").applyInArrow(_confirm(percent), "a long, b long"), name)

    blocks = scratch.table(_blocks(clusters, "n_blocks"), "blocks")
    rows = clusters.join(_small(blocks), "cluster").withColumns({"comp": F.col("rep"), "n_rest": F.lit(0).cast("long"), "main": F.col("rep")})
    first = with_sets(scratch.table(rows, "dealt")).withColumn("low", F.explode(F.when(F.col("rep") == F.col("cluster"), every).otherwise(F.array(own))))
    links = confirmed(first.withColumns({"high": F.col("low"), "side": F.lit(0)}), "links")
    if blocks.where("n_blocks > 1").isEmpty():
        return links
    joined = connected_components(links, scratch, "first")
    large = rows.where("n_blocks > 1").drop("comp", "main", "n_rest").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    large = scratch.table(large.withColumn("comp", F.coalesce("root", "rep")).drop("root"), "large")
    main = large.groupBy("cluster", "comp").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
    with_main = large.join(_small(scratch.table(main, "main")), "cluster")
    rest = scratch.table(_blocks(with_main.where("comp <> main"), "n_rest"), "rest")
    if rest.isEmpty():
        return links
    own_rest = F.when(F.col("comp") == F.col("main"), F.col("n_rest") - 1).otherwise(F.pmod(F.xxhash64("rep", F.lit(1)), F.col("n_rest")))
    apart = with_sets(scratch.table(with_main.join(_small(rest), "cluster"), "apart")).withColumns({"own": own, "own_rest": own_rest})
    lower = apart.where("comp <> main").withColumns({"low": F.col("own_rest"), "high": F.explode(every), "side": F.lit(-1)})
    upper = apart.withColumns({"low": F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_rest"))), "high": F.col("own"), "side": F.lit(1)})
    return links.unionByName(confirmed(lower.select(names).unionByName(upper.select(names)), "more-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, keep: Sequence[str] = (), group_out: str | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable by links), kept (it is that one).

    Columns named in keep follow, and with group_out a number of the row's component, null if it is alone.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets (five words; the whole sequence
    if there are fewer). Texts that are null, empty or without words have no shingles and no links; equal texts are linked.
    Ids are integers; rows that share an id are judged each by its own text; rows without an id are left out. Other columns are
    not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep)).where("id is not null")
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[2:])
    signed = scratch.table(texts.mapInArrow(_signed, f"id long, n long, digest binary, bands array<long>, sketch binary{kept}"), "signed")
    texts = texts.select("id", "text")
    same = signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = scratch.table(same.withColumn("rep", F.monotonically_increasing_id()), "reps")
    coarse = connected_components(_tied(reps, scratch), scratch, "coarse")
    whole = coarse.unionByName(coarse.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    clusters = scratch.table(whole.join(reps.select("rep", "n", "id", "digest", "sketch"), "rep"), "clusters")
    joined = connected_components(_linked(texts, clusters, percent, scratch), scratch, "joined")
    members = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "rep").join(clusters.select("rep", "id", "digest"), "rep")
    members = scratch.table(members.select("digest", "root", "id"), "members")
    least = with_least(members, "root", "id", members.count(), scratch, "least").select("digest", "m", "root")
    copies = reps.where("copies > 1").select("digest", F.col("id").alias("m"), F.col("rep").alias("root")).join(least.select("digest"), "digest", "left_anti")
    roots = scratch.table(least.unionByName(copies), "roots")
    scratch.keep("signed", "roots")
    least_id = F.coalesce("m", "id")
    more = [F.col(f"keep_{c}").alias(c) for c in keep] + ([F.col("root").alias(group_out)] if group_out else [])
    named = F.col("id").alias(id_col), F.col("n").alias("n_shingles"), least_id.alias("component_id"), (F.col("id") == least_id).alias("kept")
    return signed.join(roots, "digest", "left").select(*named, *more)
