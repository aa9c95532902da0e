"""Hard negatives against scoring every pair, and intervals against scores."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import negatives, oracles, queries


def brute(rows, anchors, k=5, low=80, high=100):
    rows = [(i, l, v) for i, l, v in rows if None not in (i, l, v) and None not in v]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    asked = {}
    for i, l, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if anchors(i):
            asked.setdefault(i, (l, v))
    out = []

    def best(pairs):
        kept = {}
        for s, i in pairs:
            kept[i] = max(s, kept.get(i, s))
        return sorted(((s, i) for i, s in kept.items()), key=lambda x: (-x[0], x[1]))[:k]

    for a, (l, v) in asked.items():
        for ps, p in best([(score(v, y), i) for i, m, y in rows if m == l and i != a]):
            found = best([(s, i) for i, m, y in rows if m != l and low * ps <= 100 * (s := score(v, y)) <= high * ps])
            out.extend((a, p, n, i, ps, s) for n, (s, i) in enumerate(found, 1))
    return sorted(out)


def plain(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("dims", "span", "n"), [(64, 60, 900), (5, 3, 400), (100, 9, 300), (1, 4, 60), (3, 2**29, 60)])
def test_brute_force(spark, monkeypatch, dims, span, n):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 12_000)
    r = random.Random(dims)
    middles = [[r.randint(-span, span) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        near = r.choice(middles)
        rows.append((i, r.randrange(4), [x + r.randint(-span, span) // 2 for x in near]))
    rows += [rows[7]] * 3 + [(5, 1, rows[0][2]), (12, 2, []), (13, 3, [span]), (20, 1, [-x for x in rows[20][2]])]
    rows += [(None, 1, rows[1][2]), (-30, None, rows[1][2]), (-40, 1, None), (-50, 1, [None, *rows[1][2][1:]])]
    df = spark.createDataFrame([(*x, "own", 9) for x in rows], "vec_id long, label int, vector array<long>, code string, rank int").repartition(5)
    got = plain(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert got == brute(rows, lambda i: i % 10 == 0) and got


def test_small_tables(spark):
    kind = "vec_id long, label int, vector array<long>"
    assert not plain(negatives.hard_negatives(spark.createDataFrame([], kind), F.col("vec_id") == 0))
    assert not plain(negatives.hard_negatives(spark.createDataFrame([(1, 1, [1]), (2, 1, [3])], kind), F.lit(True)))
    zero = [(i, i % 2, [0, 0]) for i in range(20)]
    assert plain(negatives.hard_negatives(spark.createDataFrame(zero, kind), F.col("vec_id") < 3)) == brute(zero, lambda i: i < 3)


@pytest.mark.parametrize("dims", [1, 40, 64, 130])
def test_intervals_hold(dims):
    r = np.random.default_rng(dims)
    width = max(64, 1 << (dims - 1).bit_length())
    x, z = r.integers(-300, 300, (200, dims)), r.integers(-300, 300, (30, dims))
    x[:20], x[20] = z[:20], 0
    turned = negatives.rotate(x.astype(float), width)
    assert np.allclose(turned @ negatives.rotate(z.astype(float), width).T, x @ z.T)
    a = negatives.Anchors(np.arange(30), np.zeros(30), z, width)
    low, high = a.interval(np.arange(30), *negatives.codes(x, width))
    assert ((low <= z @ x.T) & (z @ x.T <= high)).all()
    if dims >= 40:
        assert (high - low).mean() < 2.1 * np.sqrt((x**2).sum(1).mean() * (z**2).sum(1).mean())


def test_query_equals_sql(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, i % 10, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(700)]
    rows += [(700, 3, [math.nan] * 16), (800, 2, [math.inf] * 16), (900, 1, None), (1000, None, rows[0][2]), (1100, 1, [None, *rows[0][2][1:]])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    df = queries.op12_hard_negatives(spark, str(tmp_path))
    want = sorted(duck.sql(f"select {', '.join(df.columns)} from ({oracles.HARD_NEGATIVES})").fetchall())
    assert plain(df) == want and want
