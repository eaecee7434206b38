"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import pytest
from oracle import connect, spark_rows, sql_rows

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    names, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    want_names, want = sql_rows(con, SQL[name])
    assert names == want_names
    assert rows == want
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 100
