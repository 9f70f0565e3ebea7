"""Every query with SQL gives DuckDB's rows on the smallest tables; the flagship query runs."""

import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quorumlens.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows(columns, table):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(([plain(r[i]) for i in order] for r in table), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        want = duck.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_push(spark):
    plan = QUERIES["src10_posts_of_account"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "EqualTo(l_suppkey,7)" in plan
    plan = QUERIES["agg7_media_breakdown"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "CartesianProduct" not in plan
