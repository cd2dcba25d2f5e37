"""Every registered query against its SQL, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as driver
from oracle.queries import all_sql
from tests.support import SMALL
from tidemark.plans.catalog import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def sql_engine():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return f"{value:f}" if isinstance(value, Decimal) else str(value)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(all_sql())
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", list(all_sql()))
def test_query_equals_sql(spark, sql_engine, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    cursor = sql_engine.execute(all_sql()[name])
    sql_columns = [d[0] for d in cursor.description]
    assert columns == sorted(sql_columns)
    places = [sql_columns.index(c) for c in columns]
    expect = sorted(tuple(plain(r[i]) for i in places) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == expect


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0
