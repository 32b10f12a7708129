"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from vacansight.plans import catalog, oracle
from vacansight.streaming import catalog as streams


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    for t in check.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def test_every_query_has_sql():
    own = {**catalog.QUERIES, **streams.QUERIES}
    assert set(own) == set(oracle.SQL)
    assert set(oracle.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns[:2] == ["skill", "snapshot_date"]


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = check.rows_of(df.columns, df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == check.rows_of(names, cur.fetchall())
