"""Every registered query: against its SQL where it has some, else that it gives rows."""

import pytest
from harness import compare, duck

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, sf, name):
    ok, text = compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
    assert ok, text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert set(entry.entry(spark).columns) >= {"grp", "labels", "recall"}
