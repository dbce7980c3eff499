"""Each query over the smallest tables gives the rows of its SQL."""

import pytest
from compare import of_duckdb, of_spark

from proofmill import program_queries, queries

QUERIES, ORACLE_SQL = queries.QUERIES | program_queries.QUERIES, queries.ORACLE_SQL | program_queries.ORACLE_SQL

SF = "/root/testdata/sf0.001"


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, name):
    assert of_spark(QUERIES[name](spark, SF)) == of_duckdb(ORACLE_SQL[name], SF)
