"""Every registered query runs on the smallest tables; those with SQL give what DuckDB gives."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest
from conftest import TESTDATA

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{TESTDATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    if isinstance(v, (decimal.Decimal, float, int)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def test_keys_agree():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        df = QUERIES[name](spark, TESTDATA)
        columns = sorted(df.columns)
        got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    if name in SQL:
        result = duck.execute(SQL[name])
        named = [d[0] for d in result.description]
        assert sorted(named) == columns
        assert got == sorted(tuple(plain(r[named.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
