"""Every registered query against its SQL on the smallest data set."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from rosterflow import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, ORACLES = catalog.all_queries(), catalog.all_oracles()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def empty_tables(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        pq.write_table(pq.read_table(f"{sf}/{name}.parquet").slice(0, 0), os.path.join(folder, f"{name}.parquet"))
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), con


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    compare(QUERIES[name](spark, sf), duck, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql_on_empty_tables(spark, empty_tables, name):
    folder, con = empty_tables
    compare(QUERIES[name](spark, folder), con, name)


def compare(df, duck, name):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == names
    places = [found.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in places) for r in result.fetchall()), key=repr)
    assert got == want
