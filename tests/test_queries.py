"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SF, db) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
