"""Every registered query against its SQL twin on the smallest tables."""

import pathlib

import pytest

import __spark_entry__ as entry
from driver import all_queries

SF = pathlib.Path("/root/testdata/sf0.001")
TABLES = [p.stem for p in SF.glob("*.parquet")] if SF.exists() else []
pytestmark = pytest.mark.skipif(not TABLES, reason="no test tables")
QUERIES, SQL = all_queries.QUERIES, all_queries.SQL


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["fingerprint", "occurrences", "first_seen", "last_seen", "jobs"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, str(SF))
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    got = sorted(map(str, (tuple(r) for r in frame.select(*columns).collect())))
    assert got == sorted(map(str, cursor.fetchall()))
