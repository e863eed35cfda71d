"""Every query with SQL against DuckDB on the smallest tables; the others give rows of a stable shape."""

import decimal
import os

import duckdb
import pytest

from reelsift.plans import inbox, library, registry, rules, runs  # noqa: F401


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    return con


def plain(x):
    return round(float(x), 5) if isinstance(x, (float, decimal.Decimal)) else x


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(([plain(r[c]) for c in columns] for r in rows), key=repr) == sorted(([plain(r[i]) for i in order] for r in want.fetchall()), key=repr)
