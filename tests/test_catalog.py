"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from siftwell import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda x: None if x is None or x != x or str(x) == "<NA>" else round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return list(frame.columns), sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False)), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_like_duckdb(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


#: Beyond SQL; each has a test against a brute-force version.
WITHOUT_SQL = {"ct04_repaired", "rk03_full_text", "st04_agent_runs"}


def test_all_other_queries_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) | WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count()
