"""Every registered query against its SQL in DuckDB, on the smallest data set."""

import os

import pytest

import __spark_entry__ as contract
from tests.oracle import connect, difference, kinds

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = frame.toPandas()
    spark.catalog.clearCache()
    if name not in SQL:
        assert len(got)
        return
    cursor = duck.execute(SQL[name])
    types = kinds([(d[0], d[1]) for d in cursor.description])
    assert difference(got, cursor.fetchdf()) is None
    assert {n: t for n, t in kinds(frame.dtypes).items() if types.get(n) != t} == {}


def test_entry(spark):
    assert contract.entry(spark).count() == 25


def test_every_oracle_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 130
