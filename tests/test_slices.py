"""Ordered functions against a direct computation, with groups spread over several slices."""

import random

import pytest
from pyspark.sql import functions as F

from tradewind.functions import slices


@pytest.fixture(autouse=True)
def several_slices(conf):
    conf(
        spark__sql__shuffle__partitions="7",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )


def _rows(seed, n, distinct_values):
    rng = random.Random(seed)
    # Group "a" holds most rows; values tie often; some values and one group are NULL.
    return [
        (
            rng.choices(["a", "b", None], [8, 1, 1])[0],
            i,
            rng.choice([None, *range(distinct_values)]),
        )
        for i in range(n)
    ]


def _groups(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("distinct", [1, 2, 3, 50, 100_000])
def test_rank_descending(spark, distinct):
    rows = _rows(distinct, 700, distinct)
    df = spark.createDataFrame(rows, "g string, id int, v int")
    got = slices.rank_descending(df, ["g"], "v", "r")
    assert got.columns == ["g", "id", "v", "r"]
    wanted = {}
    for members in _groups(rows).values():
        for _, id_, value in members:
            above = [v for _, _, v in members if v is not None and (value is None or v > value)]
            wanted[id_] = 1 + len(above)
    assert {row["id"]: row["r"] for row in got.collect()} == wanted


def test_one_group_spans_many_slices(spark):
    df = spark.range(1000).select(F.lit("a").alias("g"), "id", (F.col("id") * 7 % 1000).cast("decimal(12,2)").alias("v"))
    assert df.select(slices.magnitude("v")).distinct().count() > 200
    got = slices.rank_descending(df, ["g"], "v", "r").collect()
    assert all(r["r"] == 1000 - int(r["v"]) for r in got)


def test_magnitude_never_falls(spark):
    values = [None, -1e12, -5.5, -5.49, -1.0, -1e-9, -0.0, 0.0, 1e-9, 0.02, 1.0, 99.999, 100.0, 1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(slices.magnitude("v"))
    steps = [r[0] for r in df.collect()]
    assert steps[0] is None and steps[1:] == sorted(steps[1:])


def test_nothing_runs_before_the_result_is_asked_for(spark):
    df = spark.range(10).select(F.lit("a").alias("g"), "id")
    group = "slices-test"
    spark.sparkContext.setJobGroup(group, "plans only")
    slices.rank_descending(df, ["g"], "id", "r")
    slices.running_total(df, ["g"], [F.col("id")], "id", "t", [F.col("id")])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("group", [[], ["g"]])
def test_row_number_and_running_total(spark, group):
    rows = _rows(5, 600, 9)
    df = spark.createDataFrame(rows, "g string, id int, v int")
    numbered = slices.row_number(df, group, [F.desc("id")], "n", [F.floor(F.col("id") / 50)], descending=True).collect()
    totals = slices.running_total(df, group, [F.col("id")], "v", "t", [F.floor(F.col("id") / 50)]).collect()
    for members in _groups(rows).values() if group else [rows]:
        ids = {row[1] for row in members}
        place = {id_: i for i, id_ in enumerate(sorted(ids, reverse=True), 1)}
        assert {r["id"]: r["n"] for r in numbered if r["id"] in ids} == place
        so_far, wanted = None, {}
        for _, id_, value in sorted(members, key=lambda row: row[1]):
            if value is not None:
                so_far = (so_far or 0) + value
            wanted[id_] = so_far
        assert {r["id"]: r["t"] for r in totals if r["id"] in ids} == wanted


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, id int, v int")
    assert slices.rank_descending(df, ["g"], "v", "r").collect() == []
    assert slices.row_number(df, [], [F.col("id")], "n", [F.col("id")]).collect() == []
