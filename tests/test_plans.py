"""What the physical plans must and must not hold, over files and without broadcasts."""

import re
from functools import partial

import pytest

import __spark_entry__ as entry
from tests.plan_text import final_plan
from tests.tiny import make_star
from tradewind.operators import advanced, integrity, kpi, selection
from tradewind.plans import base, reports, summaries
from tradewind.sources.parquet import read_star, write_star
from tradewind.sources.retail import AS_OF, load_star

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("star"))
    write_star(load_star(spark, FOLDER), folder)
    return read_star(spark, folder)


@pytest.fixture
def plan(conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__maxMetadataStringLength="10000")
    return lambda df: df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", entry._QUERIES)
def test_building_a_query_runs_nothing(spark, name):
    entry.star_of(spark, FOLDER)
    spark.sparkContext.setJobGroup(f"plan of {name}", "")
    try:
        entry.queries()[name](spark, FOLDER)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"plan of {name}")
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_each_table_is_checked_in_one_scan(files, plan):
    text = plan(integrity.referential_integrity_report(files))
    # nine tables with foreign keys, and the eight that these refer to, for their children and for themselves
    assert len(re.findall(r"FileScan parquet", text)) == 9 + 2 * 8


def test_no_shuffle_by_region(files, plan):
    text = plan(advanced.products_never_in_high_rev_regions(files, min_revenue=1))
    by_region = [line for line in text.splitlines() if "hashpartitioning(region_id" in line]
    # products per region and revenue per region, both folded before; never the orders
    assert len(by_region) <= 3 and all("ReadSchema" not in line for line in by_region)


@pytest.mark.parametrize(
    ("query", "day"), [(base.base_sales_order_line, "order_date_id"), (base.base_returns, "return_date_id")]
)
def test_shuffles_of_wide_records_carry_no_days(files, plan, query, day):
    """The calendar comes last, and orders meet customers before reps and regions give them columns."""
    joins = re.findall(r"Join \[(\w+)#", plan(query(files)))
    assert joins[0] == day and joins.count(day) == 1
    assert joins.index("order_id") < joins.index("region_id") < joins.index("sales_rep_id") < joins.index("customer_id")


@pytest.mark.parametrize("query", [base.base_sales_order_line, base.base_returns])
def test_shuffles_of_wide_records_carry_no_categories_and_texts_last(files, plan, query):
    df = query(files)
    joins = re.findall(r"Join \[(\w+)#", plan(df))
    assert joins.index("category_id") < joins.index("order_id") < joins.index("product_id")
    [orders] = [
        node.output()
        for node in shuffles(df._jdf.queryExecution().executedPlan())
        if "region_name" in node.output().mkString(" ") and "hashpartitioning(order_id" in node.toString().splitlines()[0]
    ]
    is_text = [orders.apply(k).dataType().simpleString() == "string" for k in range(orders.size())]
    assert is_text == sorted(is_text) and sum(is_text) > 8


def test_lines_without_a_return_are_dropped_before_the_shuffle(files, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    df = base.base_returns(files)
    rows = len(df.collect())
    written = [
        node.metrics().get("shuffleRecordsWritten").get().value()
        for node in shuffles(df._jdf.queryExecution().executedPlan())
        if "hashpartitioning(line_item_id" in node.toString().splitlines()[0]
    ]
    assert len(written) == 2 and rows > 100
    assert max(written) < rows * 1.05 < files.fact_order_line_items.count() / 2


@pytest.mark.parametrize("places", [1, 7, 40_000, base._PLACES])
def test_all_returned_lines_are_found(spark, monkeypatch, places):
    """However many lines share a place, and where keys repeat, dangle or are null."""
    monkeypatch.setattr(base, "_PLACES", places)
    lines = [{"line_item_id": f"{k}", "order_id": k} for k in range(500)]
    lines += [{"line_item_id": "7", "order_id": 7}, {"line_item_id": None, "order_id": 1}, {"line_item_id": "", "order_id": 2}]
    returns = [{"return_id": f"R{k}", "line_item_id": f"{k}"} for k in [*range(0, 600, 3), 7, 7]]
    returns += [{"return_id": "R", "line_item_id": None}, {"return_id": "R-", "line_item_id": ""}]
    star = make_star(spark, fact_order_line_items=lines, fact_returns=returns)
    some = base._maybe_returned(star.fact_order_line_items, star.fact_returns)
    assert some.columns == star.fact_order_line_items.columns

    def met(lines):
        return sorted(map(tuple, lines.join(star.fact_returns, "line_item_id").select("order_id", "return_id").collect()))

    assert met(some) == met(star.fact_order_line_items) and len(met(some)) == 167 + 4 + 1
    if places > 40_000:
        assert some.count() < 180


def test_lines_without_any_return(spark):
    star = make_star(spark, fact_order_line_items=[{"line_item_id": "1", "order_id": 1}])
    assert base.base_returns(star).count() == 0


def test_lines_of_one_year_only_are_summed(files, plan):
    for query in (
        partial(kpi.frequent_low_value_customers, as_of=AS_OF),
        reports.rep_performance_scorecard,
    ):
        text = plan(query(files))
        scan = text.index("line_total")
        assert "LeftSemi" in text, scan


def scans(df, column):
    """How many scans in the final plan read a column. What is reused is printed again with the same numbers."""
    df.collect()
    found = re.findall(r"FileScan parquet \[([^\]]*)\]", final_plan(df))
    return len({columns for columns in found if column in columns})


def test_the_calendar_is_read_once(spark, conf):
    """One scan for the bounds, whatever the number of roles, and one for the orders of sales and of returns each."""
    conf(spark__sql__maxMetadataStringLength="10000")
    star = load_star(spark, FOLDER)
    for query in (reports.sales_executive_summary, reports.monthly_trend):
        assert scans(query(star), "o_orderdate") <= 2, query.__name__
    assert scans(reports.product_performance(star), "o_orderdate") <= 3


def test_a_rank_shares_its_input(spark, files, conf):
    conf(spark__sql__maxMetadataStringLength="10000", spark__sql__autoBroadcastJoinThreshold="-1")
    summary, ranked = (scans(query(files), "line_total") for query in (summaries.sum_product_metrics, reports.product_performance))
    assert ranked <= summary
    summary, ranked = (scans(query(files), "line_total") for query in (summaries.sum_rep_quota_attainment, reports.rep_performance_scorecard))
    assert ranked <= summary


def test_calendar_comes_from_orders(spark, plan):
    text = plan(selection.dates_in_years(load_star(spark, FOLDER), years=(1999,)))
    assert "orders.parquet" in text and "Range (" not in text


def test_sold_products_are_looked_up_as_bits(spark):
    """Keys stay few in the driver: a row of bits for 64 neighbours, not one for each key."""
    ids = [*range(-70, 130), 2**62, 2**62 + 63, 2**63 - 1, -(2**63)]
    odd = [2**62 + 1, 500, -71, 130, None]
    products = [{"product_id": i, "category_id": 1} for i in [*ids, *ids[:5], None]] + [{"product_id": 500, "category_id": 2}]
    star = make_star(
        spark,
        dim_categories=[{"category_id": 1}],
        dim_products=products,
        fact_order_line_items=[{"line_item_id": f"{k}", "product_id": i} for k, i in enumerate([*ids, *ids[:5], *odd])],
    )
    found = star.sold_lines_by_bits
    assert found.columns == star.fact_order_line_items.columns
    assert sorted(row["product_id"] for row in found.collect()) == sorted([*ids, *ids[:5]])
    looked_up = [
        node.metrics().get("numOutputRows").get().value()
        for node in exchanges(found._jdf.queryExecution().executedPlan())
    ]
    assert looked_up and max(looked_up) < len(ids) / 10


def test_the_scorecard_looks_products_up_as_bits(files, plan):
    assert "bit_or" in plan(reports.rep_performance_scorecard(files))


def exchanges(node):
    """The broadcasts of an executed plan, those below adaptive stages included."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return exchanges(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return exchanges(node.plan())
    own = [node] if kind == "BroadcastExchangeExec" else []
    below = node.children()
    return own + [found for k in range(below.size()) for found in exchanges(below.apply(k))]


def shuffles(node):
    """The shuffles of a plan, executed or not."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffles(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffles(node.plan())
    own = [node] if kind == "ShuffleExchangeExec" else []
    below = node.children()
    return own + [found for k in range(below.size()) for found in shuffles(below.apply(k))]
