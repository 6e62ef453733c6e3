"""The queries that have SQL, against DuckDB over the test tables."""

import duckdb
import pytest

from tradewind.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_matches(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER)
    wanted = duck.execute(registry.oracle_sql()[name])
    columns = [column[0] for column in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(map(repr, (tuple(row) for row in got.select(columns).collect())))
    assert rows and rows == sorted(map(repr, wanted.fetchall()))
