"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in os.listdir(SF) if f.endswith(".parquet")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 200 and sum(r["replacements"] for r in rows) > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
