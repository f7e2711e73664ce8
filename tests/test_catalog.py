"""Every query with SQL equals it on the smallest tables; every other query runs."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET max_temp_directory_size = '2GB'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, key):
    df = entry.queries()[key](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("key", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, key):
    assert entry.queries()[key](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
