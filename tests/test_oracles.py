"""Every registered query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from quire import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.sql("set timezone = 'UTC'")
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return db


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("key", list(catalog.QUERIES))
def test_query(spark, duck, key):
    df = catalog.QUERIES[key](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if key not in catalog.ORACLE_SQL:
        assert rows
        return
    told = duck.sql(catalog.ORACLE_SQL[key])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=repr)


@pytest.mark.parametrize("key", ["tokens", "match_tags", "link_report", "find_matches", "run_recipe", "counts_report", "line_diff"])
def test_native_plans(spark, key):
    plan = catalog.QUERIES[key](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan
