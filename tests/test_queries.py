"""Every registered query against its SQL."""

import oracle
import pytest

import __spark_entry__ as driver

QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, folder, con, name):
    result = QUERIES[name](spark, folder)
    assert oracle.differences(result, SQL[name], con) == []
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
