"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph.queries import ORACLES, QUERIES

SF = os.environ.get("LOOM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

# Millions of rows whatever the tables: compared by their sums.
LARGE = {"gen_toy_k50", "gen_toy_circle"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)]
    value = lambda x: None if x is None or x != x else round(float(x), 8) if isinstance(x, float) else x
    return sorted((tuple(value(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LARGE))
def test_query(spark, db, name):
    assert normal(QUERIES[name](spark, SF).toPandas()) == normal(db.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(LARGE))
def test_large_query(spark, db, name):
    sums = "SELECT count(*), sum(src), sum(dst), sum(src * dst % 1000003), count(DISTINCT src * 1000000 + dst)"
    frame = QUERIES[name](spark, SF)
    frame.createOrReplaceTempView("large")
    assert tuple(spark.sql(f"{sums} FROM large").first()) == db.execute(f"{sums} FROM ({ORACLES[name]}) AS x").fetchone()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
