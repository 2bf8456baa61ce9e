"""Every registered query against its SQL; queries without SQL must run and give rows."""

import pytest

import oracle
from textmill.queries import all_queries

SF_DIR = f"{oracle.TESTDATA}/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    query = QUERIES[name]
    columns, rows = oracle.spark_rows(query.run(spark, SF_DIR))
    if query.sql is None:
        assert rows
        return
    expected_columns, expected = oracle.sql_rows(connection, query.sql)
    assert columns == expected_columns
    assert rows == expected


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
