"""Every core query with SQL gives the same rows in Spark and in DuckDB."""

import pytest

from compare import assert_same
from valora import queries

SQL = queries.sql()
SLOW = {"ridge_train"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, oracle, name):
    assert_same(queries.QUERIES[name](spark, data).toPandas(), oracle.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(SQL) - SLOW))
def test_query_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() >= 0


def test_sql_keys_are_queries():
    assert set(SQL) <= set(queries.QUERIES)
