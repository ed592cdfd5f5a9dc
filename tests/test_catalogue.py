"""Every catalogue query against DuckDB on the smallest tables."""

import duckdb
import pytest

from sparquill.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _plain(v):
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.SQL:
        assert got
        return
    out = duck.execute(catalogue.SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    want = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in out.fetchall())
    assert got == want


def test_plans_push_and_prune(spark):
    plan = catalogue.QUERIES["quality_filtered_bm25"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)" in plan
    assert "lang" not in plan and "n_chars" not in plan
