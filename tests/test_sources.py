from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.tiny import DIMENSIONS, by, day, make_star, sales
from tradewind import Star
from tradewind.operators import advanced, selection
from tradewind.plans.views import register_views
from tradewind.schema import TABLES, struct_of
from tradewind.sources import csv, parquet, retail, tables


@pytest.fixture
def extract(tmp_path):
    def write(table, rows, ending):
        header = ",".join(f.name for f in struct_of(table))
        path = tmp_path / f"{table}.csv"
        path.write_bytes((ending.join([header, *rows]) + "\r\n").encode("utf-8"))
        return str(path)

    return write


@pytest.mark.parametrize("ending", ["\n", "\r\n", "\r"])
def test_csv_record_endings_and_types(spark, extract, ending):
    path = extract(
        "dim_products",
        ["7,90007,Crème brûlée tin,3,12.05,3.10,40,false,2/29/2024", "8,90008,Peg,3,0.75,,0,true,11/30/2023"],
        ending,
    )
    rows = by(csv.read_table(spark, path, "dim_products"), "product_id")
    assert set(rows) == {7, 8}
    assert rows[7].product_name == "Crème brûlée tin" and rows[7].unit_cost == D("12.05")
    assert rows[7].created_at == date(2024, 2, 29) and rows[7].is_active is False
    assert rows[8].list_price is None and rows[8].created_at == date(2023, 11, 30)


def test_csv_flags_open_ends_and_mangled_times(spark, extract):
    path = extract(
        "rep_customer_assignments", ["5,3,4,20230102,20230304,0,09:08.7", "6,3,4,20230305,,1,09:08.7"], "\r"
    )
    rows = by(csv.read_table(spark, path, "rep_customer_assignments"), "assignment_id")
    assert (rows[5].is_primary_rep, rows[6].is_primary_rep) == (False, True)
    assert rows[6].end_date_id is None and rows[5].created_at == "09:08.7"


def test_all_extracts_of_a_folder(spark, extract, tmp_path):
    for table in csv.EXTRACTS:
        extract(table, [], "\n")
    tables_ = csv.read_extracts(spark, str(tmp_path))
    assert sorted(tables_) == sorted(csv.EXTRACTS) and len(tables_) == 7
    for name, table in tables_.items():
        assert table.columns == struct_of(name).fieldNames() and table.count() == 0


def test_csv_refuses_another_table(spark, extract):
    path = extract("dim_regions", ["1,Mali,Africa,West,ML,true,1/1/2024"], "\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        csv.read_table(spark, path, "dim_categories").collect()


def test_csv_refuses_bad_numbers(spark, extract):
    path = extract("fact_quotas", ["9,2,5,20230601,Monthly,many,01:02.3"], "\r")
    with pytest.raises(Exception, match="(?i)cast"):
        csv.read_table(spark, path, "fact_quotas").collect()


def test_parquet_round_trip_and_day_pruning(spark, tmp_path):
    orders = [(i, 1, 1, 1, f"2024-0{1 + i % 9}-05", [(1, 1, i)]) for i in range(30)]
    quotas = [
        {"quota_id": 1, "sales_rep_id": 1, "region_id": 1, "date_id": day("2024-01-01"),
         "quota_period_type": "Monthly", "quota_target": 5}
    ]
    star = make_star(spark, **DIMENSIONS, **sales(orders), fact_quotas=quotas)
    parquet.write_star(star, str(tmp_path))
    read = parquet.read_star(spark, str(tmp_path))
    for name in TABLES:
        table = getattr(read, name)
        assert dict(table.dtypes) == {f.name: f.dataType.simpleString() for f in struct_of(name)}, name
        columns = struct_of(name).fieldNames()
        assert sorted(map(repr, table.select(columns).collect())) == sorted(
            map(repr, getattr(star, name).select(columns).collect())
        )
    top = advanced.top_customer_per_country(read)
    assert [r.customer_id for r in top.collect()] == [1]
    # Only the order dates of the year are read.
    assert "dynamicpruning" in top._jdf.queryExecution().executedPlan().toString()


def test_retail_star_has_the_schema_and_keeps_every_row(spark):
    folder = "/root/testdata/sf0.001"
    star = retail.load_star(spark, folder)
    for name in Star.names():
        got = {f.name: f.dataType.simpleString() for f in getattr(star, name).schema}
        assert got == {f.name: f.dataType.simpleString() for f in struct_of(name)}, name
    sources = {
        "fact_order_line_items": "lineitem",
        "fact_sales_orders": "orders",
        "dim_customers": "customer",
        "dim_products": "part",
        "dim_sales_reps": "supplier",
    }
    for name, source in sources.items():
        assert getattr(star, name).count() == spark.read.parquet(f"{folder}/{source}.parquet").count()
    for name, key in [("fact_order_line_items", "line_item_id"), ("fact_quotas", "quota_id")]:
        table = getattr(star, name)
        assert table.select(key).distinct().count() == table.count()


def test_views_answer_sql(spark):
    star = make_star(spark, **DIMENSIONS, **sales([(1, 1, 1, 1, "2024-01-05", [(1, 1, 10)])]))
    names = register_views(star, as_of=date(2024, 12, 31))
    assert len(names) == 16
    row = spark.sql(
        "SELECT sum(net_revenue) AS net FROM vw_sum_monthly_country_sales JOIN dim_regions"
        " ON country_name = region_country_name WHERE territory_name = 'North'"
    ).first()
    assert row.net == 10
    for name in names:
        spark.table(name).collect()


def test_bucketed_tables_join_orders_and_lines_without_a_shuffle(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    orders = [(i, 1 + i % 2, 1, 1, f"2024-0{1 + i % 9}-05", [(1, 1, i), (2, 1, 1)]) for i in range(30)]
    star = make_star(spark, **DIMENSIONS, **sales(orders))
    wanted = selection.gross_rev_month_region_country(star).collect()
    try:
        tables.save_star(star, "lumpy")
        lumpy = selection.gross_rev_month_region_country(tables.table_star(spark, "lumpy"))
        assert lumpy.collect() == wanted
        tables.save_star(star, "even", buckets=4)
        even = selection.gross_rev_month_region_country(tables.table_star(spark, "even"))
        assert even.collect() == wanted
        assert "hashpartitioning(order_id" in lumpy._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(order_id" not in even._jdf.queryExecution().executedPlan().toString()
    finally:
        for database in ("lumpy", "even"):
            spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")


def test_filters_and_columns_reach_the_scan(spark, conf, tmp_path):
    conf(spark__sql__maxMetadataStringLength="10000")
    star = make_star(spark, **DIMENSIONS)
    parquet.write_star(star, str(tmp_path))
    read = parquet.read_star(spark, str(tmp_path))
    gold = selection.gold_high_credit(read)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(account_tier,Gold)" in gold and "GreaterThan(credit_limit" in gold
    summary = selection.product_sales_summary(read)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<product_id:bigint,quantity:int,line_total:decimal(14,2)>" in summary
    top = advanced.top_customer_per_country(read)._jdf.queryExecution().executedPlan().toString()
    assert top.count("WindowGroupLimit") == 2


def test_quotas_are_not_taken_for_a_small_table(spark):
    """Spark broadcasts what it takes for small. A rep has over a hundred quotas, and the estimate has to know."""
    reps = spark.range(1, 2001).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey"))
    quotas = retail._quotas(reps, date(1995, 1, 1), date(2001, 8, 1))
    # 80 months and 27 quarters, twice for every seventh rep
    assert quotas.count() == 107 * (2000 + 2000 // 7)
    assert int(quotas._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 8 * quotas.count()


def test_quotas_begin_with_the_first_whole_month(spark):
    reps = spark.createDataFrame([(7, 1), (8, None)], "s_suppkey bigint, s_nationkey int")
    quotas = retail._quotas(reps, date(2000, 11, 2), date(2001, 1, 31))
    rows = sorted((r.sales_rep_id, r.date_id, r.quota_period_type, r.quota_target) for r in quotas.collect())
    month, quarter = 7 * 7919 + 50000, 3 * (7 * 7919 + 50000)
    one = [(7, 20001201, "Monthly", month), (7, 20010101, "Monthly", month), (7, 20010101, "Quarterly", quarter)]
    assert rows[:6] == sorted(2 * one)
    assert [r[:3] for r in rows[6:]] == [(8, *r[1:3]) for r in one]
