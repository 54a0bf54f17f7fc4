"""Every query against its SQL twin in DuckDB."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as driver
from twinsift.plans import catalog

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES = driver.queries()
SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.9g}"
    return repr(value)


def test_every_query_has_a_twin():
    assert set(SQL) <= set(QUERIES) and set(catalog.QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = sorted([plain(r[c]) for c in sorted(frame.columns)] for r in frame.collect())
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert got == sorted([plain(row[i]) for i in order] for row in cursor.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
