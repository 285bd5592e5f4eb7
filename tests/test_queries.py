"""Every registered query on the smallest tables against its SQL."""

import os

import duckdb
import pytest
from conftest import DATA

from lorespark.plans import ORACLES, QUERIES


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got or name == "cache_eviction"
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
