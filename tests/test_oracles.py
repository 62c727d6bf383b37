"""Every catalog query against equivalent SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from oracle_check import connect, differences

SQL = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def db(small_data):
    return connect(small_data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, small_data, db, name):
    assert differences(QUERIES[name](spark, small_data), db, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_returns_rows(spark, small_data, name):
    assert QUERIES[name](spark, small_data).count() > 0


def test_comparison_notices_differences(spark, db):
    one = spark.sql("SELECT 1L AS a, 2.5D AS b")
    assert differences(one, db, "SELECT 2.5::DOUBLE AS b, 1::BIGINT AS a") is None
    assert differences(one, db, "SELECT 2.5::DOUBLE AS b, 2::BIGINT AS a") is not None
    assert differences(one, db, "SELECT 2.5::DOUBLE AS b, 1::BIGINT AS c") is not None
    assert differences(one, db, "SELECT 2.5::DOUBLE AS b, 1::BIGINT AS a WHERE false") is not None


def test_entry_has_rows(spark, small_data):
    assert entry_points.entry(spark).count() == 12
