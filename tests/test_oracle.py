"""Every panel query with SQL against DuckDB, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from quantpanel import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    made = catalog.QUERIES[name](spark, DATA)
    columns = sorted(made.columns)
    ours = sorted(tuple(map(plain, r)) for r in made.select(*columns).collect())
    theirs = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(theirs.columns) == columns
    assert ours == sorted(tuple(map(plain, r)) for r in theirs.select(*columns).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
