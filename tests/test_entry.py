"""Every query with SQL gives DuckDB's rows on the smallest tables; every query has a stable schema."""

import glob
import os

import duckdb
import pytest

from quernlog.plans import events

SF = "/root/testdata/sf0.001"


def cells(rows):
    return sorted(tuple("~null" if v is None or v != v else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(events.queries()))
def test_query_matches_sql(spark, con, name):
    got = events.queries()[name](spark, SF)
    want = con.execute(events.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert cells(got.select(*columns).collect()) == cells(want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
