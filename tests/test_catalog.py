"""Registered queries against their SQL in DuckDB, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from catalog.oracle import ORACLE_SQL
from catalog.queries import QUERIES
from check import connect, normal


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["variable", "value", "n"] and result.count() == 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    mine = entry.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert normal(mine) == normal(theirs)
    assert len(mine) > 0


def test_no_data_in_the_repository():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    kept = [f for _, _, files in os.walk(root) for f in files if f.endswith((".parquet", ".csv"))]
    assert kept == []
