"""Every registered query against its SQL over the test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem".split()
TYPES = {
    "bigint": {"BIGINT", "NUMBER"},
    "double": {"DOUBLE", "NUMBER"},
    "string": {"VARCHAR", "STRING"},
    "date": {"DATE"},
    "timestamp_ntz": {"TIMESTAMP", "DATETIME"},
    "boolean": {"BOOLEAN", "bool"},
}
# Results the test tables leave empty at the smallest scale; tests/test_operators.py covers them.
MAY_BE_EMPTY = {
    "customers_created_between",
    "gold_high_credit",
    "rep_quarter_below_quota",
    "frequent_low_value_customers",
}

# The text queries have tests of their own.
queries = {name: query for name, query in entry.queries().items() if name in entry._QUERIES}
oracles = {name: sql for name, sql in entry.oracle_sql().items() if name in entry._QUERIES}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS FROM '{FOLDER}/{table}.parquet'")
    return connection


def check(spark, duck, name):
    got = queries[name](spark, FOLDER)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    wanted = duck.execute(oracles[name])
    types = {column[0]: str(column[1]) for column in wanted.description}
    assert sorted(got.columns) == sorted(types)
    for field in got.schema:
        assert types[field.name] in TYPES[field.dataType.simpleString()], field
    rows = sorted(map(repr, (tuple(row) for row in got.select(list(types)).collect())))
    assert rows == sorted(map(repr, wanted.fetchall()))
    assert rows or name in MAY_BE_EMPTY


def test_every_query_has_an_oracle():
    assert set(queries) == set(oracles)


@pytest.mark.parametrize("name", queries)
def test_matches(spark, duck, name):
    check(spark, duck, name)


@pytest.mark.parametrize("name", queries)
def test_matches_without_broadcasts_and_with_all_partitions(spark, duck, conf, name):
    """As on a cluster, where tables are too large to broadcast and groups span partitions."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="5",
    )
    check(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
