"""Every registered query with SQL equals DuckDB on the same tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect, rows

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "query_id"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf, name):
    problems, _ = compare(spark, con, QUERIES[name], SQL[name], sf)
    assert not problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).toArrow().num_rows > 0


@pytest.mark.parametrize("name", ["hybrid_search", "knn_exact_many", "upsert_columns", "chat_prompt", "k_hop"])
def test_same_rows_for_other_partitioning(spark, sf, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = rows(QUERIES[name](spark, sf).toArrow())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert rows(QUERIES[name](spark, sf).toArrow()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
