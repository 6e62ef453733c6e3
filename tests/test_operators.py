"""Behaviour that the generated tables cannot show."""

import random
from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.tiny import CUSTOMERS, DIMENSIONS, PRODUCTS, REGIONS, REPS, by, day, days_after, make_star, sales
from tradewind.operators import advanced, integrity, joins, kpi, questions, selection
from tradewind.plans import base, reports, summaries
from tradewind.plans.views import register_views
from tradewind.sources import tables

AS_OF = date(2024, 12, 31)


@pytest.fixture(autouse=True)
def few_partitions(conf):
    conf(spark__sql__shuffle__partitions="2")


def quota(id_, rep, start, kind, target, region=1):
    return {
        "quota_id": id_,
        "sales_rep_id": rep,
        "region_id": region,
        "date_id": day(start),
        "quota_period_type": kind,
        "quota_target": target,
    }


def assignment(id_, rep, customer, start, end=None, primary=True):
    return {
        "assignment_id": id_,
        "sales_rep_id": rep,
        "customer_id": customer,
        "start_date_id": day(start),
        "end_date_id": None if end is None else day(end),
        "is_primary_rep": primary,
    }


# Selection


def test_created_between_ends_at_midnight(spark):
    customers = [
        {"customer_id": 1, "created_at": datetime(2023, 9, 9)},
        {"customer_id": 2, "created_at": datetime(2026, 1, 31)},
        {"customer_id": 3, "created_at": datetime(2026, 1, 31, 0, 0, 1)},
    ]
    star = make_star(spark, dim_customers=customers)
    assert set(by(selection.customers_created_between(star), "customer_id")) == {1, 2}


def test_name_prefix_ignores_case(spark):
    reps = [{"sales_rep_id": i, "first_name": name} for i, name in enumerate(["ann", "Abe", "Bo", None])]
    star = make_star(spark, dim_sales_reps=reps)
    assert set(by(selection.reps_name_prefix(star), "sales_rep_id")) == {0, 1}


def test_margin_band_uses_the_unrounded_margin_and_no_price_is_low(spark):
    products = [
        {"product_id": 1, "unit_cost": "40.00", "list_price": "100.00", "is_active": True},
        {"product_id": 2, "unit_cost": "40.004", "list_price": "100.00", "is_active": True},
        {"product_id": 3, "unit_cost": "1", "list_price": "0", "is_active": True},
        {"product_id": 4, "unit_cost": "4000.01", "list_price": "10000.00", "is_active": True},
        {"product_id": 5, "unit_cost": "1", "list_price": "9", "is_active": False},
    ]
    for product in products:
        product["unit_cost"] = D(product["unit_cost"]).quantize(D("0.01"))
    bands = by(selection.product_margin_band(make_star(spark, dim_products=products)), "product_id")
    assert bands[1].margin_category == "High Margin"
    assert bands[3].margin_category == "Low Margin" and bands[3].gross_margin_pct is None
    # Rounds to 60.00 but is below it.
    assert bands[4].gross_margin_pct == D("60.00") and bands[4].margin_category == "Medium Margin"
    assert 5 not in bands


def test_percentages_round_half_away_from_zero(spark):
    lines = [
        {"line_item_id": "a", "product_id": 1, "discount_amount": "1.00", "line_total": "800.00"},
        {"line_item_id": "b", "product_id": 2, "discount_amount": "-1.00", "line_total": "800.00"},
        {"line_item_id": "c", "product_id": 3, "discount_amount": "1.00", "line_total": "0.00"},
    ]
    star = make_star(spark, fact_order_line_items=lines)
    impact = by(selection.discount_impact(star), "product_id")
    assert impact[1].discount_impact_pct == D("0.13")
    assert impact[2].discount_impact_pct == D("-0.13")
    assert impact[3].discount_impact_pct is None and impact[3].discount_level == "Low Discount"


def test_customer_rules_in_order(spark):
    good = {"customer_code": "C", "customer_name": "N", "country_name": "P", "credit_limit": 50000}
    customers = [
        {**good, "customer_id": 1},
        {**good, "customer_id": 2, "customer_code": "   ", "customer_name": None},
        {**good, "customer_id": 3, "customer_name": ""},
        {**good, "customer_id": 4, "country_name": None},
        {**good, "customer_id": 5, "credit_limit": None},
        {**good, "customer_id": 6, "credit_limit": -1},
        {**good, "customer_id": 7, "credit_limit": 45000},
    ]
    star = make_star(spark, dim_customers=customers)
    status = {k: r.validation_status for k, r in by(selection.customer_validation(star), "customer_id").items()}
    assert status == {1: "Valid", 2: "Missing customer code", 3: "Missing customer name", 4: "Missing country"}
    everyone = by(selection.customer_validation(star, min_credit=None), "customer_id")
    assert everyone[5].validation_status == "Missing credit limit"
    assert everyone[6].validation_status == "Invalid credit limit"
    assert everyone[7].validation_status == "Valid"


def test_order_rules_in_order(spark):
    good = {"customer_id": 1, "sales_rep_id": 1, "order_date_id": 1, "net_total": 2000}
    orders = [
        {**good, "order_id": 1},
        {**good, "order_id": 2, "customer_id": None, "sales_rep_id": None},
        {**good, "order_id": 3, "sales_rep_id": None},
        {**good, "order_id": 4, "order_date_id": None},
        {**good, "order_id": 5, "net_total": None},
        {**good, "order_id": 6, "net_total": 0},
    ]
    star = make_star(spark, fact_sales_orders=orders)
    assert set(by(selection.order_validation(star), "order_id")) == {1, 2, 3, 4}
    status = by(selection.order_validation(star, min_total=None), "order_id")
    assert [status[i].validation_status for i in range(1, 7)] == [
        "Valid",
        "Missing customer",
        "Missing sales rep",
        "Missing date reference",
        "Missing net total",
        "Invalid total",
    ]


# Questions


def test_reps_without_recent_assignment(spark):
    rows = [
        assignment(1, 1, 1, "2024-01-01"),
        assignment(2, 1, 2, "2024-02-01"),
        assignment(3, 1, 2, "2024-12-01"),
        assignment(4, 3, 1, "2024-06-30"),
    ]
    star = make_star(spark, dim_sales_reps=REPS, rep_customer_assignments=rows)
    as_coded = questions.reps_without_recent_assignment(star, as_of=AS_OF).collect()
    # Rep 1 once per old assignment in spite of the new one; rep 2 has none; rep 3's started six
    # months ago to the day (30 June, the last day of that month) and so is recent.
    assert sorted(row.sales_rep_id for row in as_coded) == [1, 1, 2]
    assert set(by(questions.unassigned_reps(star, as_of=AS_OF), "sales_rep_id")) == {2}


def test_zero_price_has_no_margin(spark):
    products = [{"product_id": 1, "product_name": "x", "unit_cost": -1, "list_price": 0}]
    row = questions.margin_over_3x(make_star(spark, dim_products=products)).first()
    assert row.margin_percentage is None


def test_delay_is_more_than_the_limit(spark):
    orders = [
        {"order_number": "a", "customer_id": 1, "order_date_id": 20240101, "shipping_date_id": 20240115},
        {"order_number": "b", "customer_id": 1, "order_date_id": 20240101, "shipping_date_id": 20240116},
        {"order_number": "c", "customer_id": 1, "order_date_id": 20240101, "shipping_date_id": None},
    ]
    star = make_star(spark, dim_customers=CUSTOMERS, fact_sales_orders=orders)
    assert set(by(questions.delayed_shipments(star, country="Peru"), "order_number")) == {"b"}


# KPIs


def test_quota_fan_out(spark):
    orders = sales(
        [
            (1, 1, 1, 1, "2024-03-02", [(1, 1, 100)]),
            (2, 1, 1, 1, "2024-03-09", [(1, 1, 50)]),
            (3, 1, 1, 1, "2024-04-09", [(1, 1, 70)]),
        ]
    )
    quotas = [
        quota(1, 1, "2024-03-01", "Monthly", 1000),
        quota(2, 1, "2024-03-15", "Monthly", 500),
        quota(3, 1, "2024-03-01", "Quarterly", 9000),
    ]
    star = make_star(spark, **DIMENSIONS, **orders, fact_quotas=quotas)
    row = kpi.quota_attainment_monthly(star).collect()
    assert len(row) == 1
    # Two orders times two quotas: 2 * 150 against 2 * 1500.
    assert (row[0].actual_revenue, row[0].total_quota_target) == (300, 3000)
    once = kpi.quota_attainment_once(star).first()
    assert (once.actual_revenue, once.total_quota_target) == (150, 1500)
    assert once.quota_attainment_pct == D("10.00")


def test_below_quota(spark):
    orders = sales(
        [
            (1, 1, 1, 1, "2024-03-02", [(1, 1, 600_000)]),
            (2, 1, 2, 1, "2024-03-02", [(1, 1, 600_000)]),
            (3, 1, 3, 1, "2024-03-02", [(1, 1, 400_000)]),
        ]
    )
    quotas = [
        quota(1, 1, "2024-01-01", "Quarterly", 750_000),
        quota(2, 2, "2024-01-01", "Quarterly", 750_001),
        quota(3, 3, "2024-01-01", "Quarterly", 9_000_000),
        quota(4, 1, "2024-01-01", "Monthly", 9_000_000),
    ]
    star = make_star(spark, **DIMENSIONS, **orders, fact_quotas=quotas)
    # Rep 1 is at exactly 80 %, rep 3 sold too little.
    assert set(by(kpi.rep_quarter_below_quota(star), "sales_rep_id")) == {2}


def test_category_margin_is_the_mean_of_line_margins(spark):
    items = [(1, 1, 10), (1, 2, 10), (1, 1, 0), (2, 1, 100)]
    star = make_star(spark, **DIMENSIONS, **sales([(1, 1, 1, 1, "2024-03-02", items)]))
    # Category 1: (60 % + 20 %) / 2; the line without a total has no margin.
    margins = by(kpi.low_margin_categories(star, max_margin=41), "category_id")
    assert margins[1].avg_gross_margin_pct == 40.0
    assert 2 not in margins


def test_frequent_low_value_customers(spark):
    orders = [(i, 1, 1, 1, "2023-05-05", [(1, 1, 100)]) for i in range(11)]
    orders += [(20 + i, 2, 1, 1, "2023-05-05", [(1, 1, 100)]) for i in range(10)]
    orders += [(50 + i, 2, 1, 1, "2024-05-05", [(1, 1, 100)]) for i in range(10)]
    star = make_star(spark, **DIMENSIONS, **sales(orders))
    rows = by(kpi.frequent_low_value_customers(star, as_of=AS_OF), "customer_id")
    assert set(rows) == {1} and rows[1].average_order_value == 100


# Joins


def test_mismatch_takes_the_latest_valid_assignment(spark):
    rows = [
        assignment(1, 1, 1, "2023-01-01", "2023-12-31"),
        assignment(2, 2, 1, "2023-06-01", "2023-06-30"),
        # Starts with number 4 but lasts longer, so it wins while both are valid and after.
        assignment(3, 3, 1, "2024-01-01", "2024-03-31"),
        assignment(4, 1, 1, "2024-01-01", "2024-01-31"),
        # Alike but for the id: the higher one wins.
        assignment(5, 1, 1, "2024-06-01"),
        assignment(6, 2, 1, "2024-06-01"),
    ]
    orders = [
        (1, 1, 1, 1, "2023-06-15", []),
        (2, 1, 1, 1, "2023-07-01", []),
        (3, 1, 1, 1, "2024-01-15", []),
        (4, 1, 3, 1, "2024-04-15", []),
        (5, 1, 1, 1, "2024-06-01", []),
        (6, 2, 1, 1, "2024-06-01", []),
    ]
    star = make_star(spark, **DIMENSIONS, **sales(orders), rep_customer_assignments=rows)
    found = {k: r.assigned_rep for k, r in by(joins.rep_customer_mismatch(star), "order_id").items()}
    # 2: back to the year-long assignment, which is right. 4: no valid one. 6: never assigned.
    assert found == {1: 2, 3: 3, 5: 2}


@pytest.mark.parametrize("seed", range(3))
def test_mismatch_equals_each_day_judged_alone(spark, seed):
    """Spans that nest, overlap, touch, end before they start or have no end, for many customers."""
    pick = random.Random(seed)
    customers = [{"customer_id": c, "customer_name": f"N{c}"} for c in range(40)]
    spans = []
    for number in range(400):
        start, length = pick.randrange(60), pick.choice([-1, 0, 0, 1, 2, 5, 9, 30, None])
        end = None if length is None else days_after("2024-01-01", max(start + length, 0))
        spans.append(assignment(number, pick.randrange(6), pick.randrange(40), days_after("2024-01-01", start), end))
    orders = [
        (k, pick.randrange(40), pick.randrange(6), 1, days_after("2024-01-01", pick.randrange(70)), []) for k in range(1500)
    ]
    star = make_star(spark, dim_customers=customers, **sales(orders), rep_customer_assignments=spans)
    expected = {}
    for order, customer, rep, _, placed, _ in orders:
        valid = [
            (a["start_date_id"], a["end_date_id"] or 99991231, a["assignment_id"], a["sales_rep_id"])
            for a in spans
            if a["customer_id"] == customer and a["start_date_id"] <= day(placed) <= (a["end_date_id"] or 99991231)
        ]
        if valid and max(valid)[3] != rep:
            expected[order] = max(valid)[3]
    assert {r.order_id: r.assigned_rep for r in joins.rep_customer_mismatch(star).collect()} == expected


def test_rollup_keeps_totals_when_a_member_is_null(spark):
    orders = [
        (1, 1, 1, 1, "2024-01-01", [(1, 1, 10)]),
        (2, 1, 1, 2, "2024-01-01", [(1, 1, 20)]),
        (3, 2, 1, 3, "2024-01-01", [(1, 1, 40)]),
    ]
    rows = joins.geo_revenue_rollup(make_star(spark, **DIMENSIONS, **sales(orders))).collect()
    found = sorted((r.country_name, r.region_name, r.territory_name, int(r.total_revenue)) for r in rows)
    # The nameless territory of Peru shows as 'ALL TERRITORIES' beside the region's real total.
    assert found == sorted(
        [
            ("ALL COUNTRIES", "ALL REGIONS", "ALL TERRITORIES", 70),
            ("Mali", "ALL REGIONS", "ALL TERRITORIES", 40),
            ("Mali", "Africa", "ALL TERRITORIES", 40),
            ("Mali", "Africa", "West", 40),
            ("Peru", "ALL REGIONS", "ALL TERRITORIES", 30),
            ("Peru", "America", "ALL TERRITORIES", 30),
            ("Peru", "America", "ALL TERRITORIES", 20),
            ("Peru", "America", "North", 10),
        ]
    )


def test_zero_quantity_has_no_unit_price(spark):
    star = make_star(spark, **DIMENSIONS, **sales([(1, 1, 1, 1, "2024-01-01", [(1, 0, 10), (1, 4, 10)])]))
    rows = by(joins.unit_price_vs_cost(star), "line_item_id")
    assert rows["1-1"].actual_unit_sell_price is None and rows["1-1"].unit_margin is None
    assert (rows["1-2"].actual_unit_sell_price, rows["1-2"].unit_margin) == (D("2.50"), D("-1.50"))


def test_customers_of_one_name_merge(spark):
    namesakes = [{**customer, "customer_name": "Ada"} for customer in CUSTOMERS]
    orders = [(i, i, 1, 1, "2024-01-01", [(1, 1, 10)]) for i in (1, 2)]
    star = make_star(spark, **{**DIMENSIONS, "dim_customers": namesakes}, **sales(orders))
    assert [r.total_revenue for r in joins.revenue_customer_region_country(star).collect()] == [20]
    # The other report keeps customers apart and counts only orders with lines.
    orders.append((3, 1, 1, 1, "2024-01-01", []))
    star = make_star(spark, **{**DIMENSIONS, "dim_customers": namesakes}, **sales(orders))
    assert [r.total_orders for r in joins.customer_order_performance(star).collect()] == [1, 1]


def test_returns_value_is_per_unit(spark):
    star = make_star(
        spark,
        **DIMENSIONS,
        **sales([(1, 1, 1, 1, "2024-01-01", [(1, 3, 10), (1, 0, 10)])]),
        fact_returns=[
            {"return_id": "a", "line_item_id": "1-1", "return_quantity": 1},
            {"return_id": "b", "line_item_id": "1-1", "return_quantity": 1},
            {"return_id": "c", "line_item_id": "1-2", "return_quantity": 5},
        ],
    )
    row = joins.returns_by_product_region(star).first()
    assert (row.total_returns, row.total_returned_quantity) == (3, 7)
    assert row.estimated_return_value == D("6.666667")


# Rankings and windows


def test_top_customer_tie_and_calendar_year(spark):
    namesakes = [{**customer, "country_name": "Peru"} for customer in CUSTOMERS]
    orders = [
        (1, 2, 1, 1, "2024-01-01", [(1, 1, 10)]),
        (2, 1, 1, 1, "2024-01-01", [(1, 1, 10)]),
        (3, 2, 1, 1, "2023-01-01", [(1, 1, 99)]),
    ]
    star = make_star(spark, **{**DIMENSIONS, "dim_customers": namesakes}, **sales(orders))
    assert [r.customer_id for r in advanced.top_customer_per_country(star).collect()] == [1]


def test_previous_month_is_the_previous_present_one(spark):
    orders = [
        (1, 1, 1, 3, "2023-12-01", [(1, 1, 100)]),
        (2, 1, 1, 3, "2024-03-01", [(1, 1, 150)]),
    ]
    star = make_star(spark, **DIMENSIONS, **sales(orders))
    change = by(advanced.country_mom_change(star), "year_num")
    assert change[2023].previous_month_revenue is None and change[2023].revenue_change_pct is None
    assert change[2024].revenue_change == 50 and change[2024].revenue_change_pct == D("50.00")
    trend = by(reports.monthly_trend(star), "year_num")
    assert trend[2024].month_over_month_pct_change == 50.0


def test_running_total_restarts_each_quarter_and_ends_at_its_total(spark):
    orders = [(i, 1, 1, 1 + i % 3, f"2024-0{1 + i % 6}-1{i % 7}", [(1, 1, i)]) for i in range(60)]
    star = make_star(spark, **DIMENSIONS, **sales(orders))
    running = advanced.quarter_running_total(star).collect()
    so_far = {}
    for row in running:
        key = (row.region_name, row.year_num, row.quarter_num)
        so_far[key] = so_far.get(key, 0) + row.net_total
        assert row.running_quarter_revenue == so_far[key]
    assert len(running) == 60 and sum(so_far.values()) == sum(range(60))


def test_rep_rank_ties(spark):
    orders = [
        (1, 1, 1, 1, "2024-01-05", [(1, 1, 100)]),
        (2, 1, 2, 1, "2024-01-05", [(1, 1, 50)]),
    ]
    quotas = [
        quota(1, 1, "2024-01-01", "Monthly", 100),
        quota(2, 1, "2024-01-01", "Quarterly", 100),
        quota(3, 2, "2024-01-01", "Quarterly", 100),
        # Another region than the rep's own: not matched.
        quota(4, 2, "2024-01-01", "Quarterly", 7, region=3),
    ]
    star = make_star(spark, **DIMENSIONS, **sales(orders), fact_quotas=quotas)
    ranks = by(advanced.rep_rank_in_region(star), "sales_rep_id")
    assert (ranks[1].quota_target, ranks[1].quota_attainment_pct) == (200, D("50.00"))
    assert [ranks[1].rep_rank_in_region, ranks[2].rep_rank_in_region] == [1, 1]


def test_lost_needs_a_leap_day(spark):
    orders = [(1, 1, 1, 1, "2023-12-31", [(1, 1, 10)]), (2, 2, 1, 1, "2024-12-30", [(1, 1, 10)])]
    star = make_star(spark, **DIMENSIONS, **sales(orders))
    segments = by(advanced.customer_rfm_1y(star), "customer_id")
    assert segments[1].recency_days == 366 and segments[1].rfm_segment == "Lost"
    assert segments[2].rfm_segment == "New"


def test_products_never_in_high_revenue_regions(spark):
    orders = [
        (1, 1, 1, 1, "2024-06-01", [(1, 1, 2_000_000)]),
        # Sold there long before the region's revenue was high.
        (2, 1, 1, 1, "2023-01-01", [(2, 1, 1)]),
        (3, 1, 1, 3, "2024-06-01", [(3, 1, 1)]),
    ]
    star = make_star(spark, **DIMENSIONS, **sales(orders))
    assert set(by(advanced.products_never_in_high_rev_regions(star), "product_id")) == {3}


def test_quarter_decline(spark):
    orders = [
        (1, 1, 1, 1, "2023-01-01", [(1, 1, 10)]),
        (2, 1, 1, 1, "2023-02-01", [(1, 1, 10)]),
        # The next active quarter: fewer orders, more revenue.
        (3, 1, 1, 1, "2023-10-01", [(1, 1, 90)]),
        (4, 1, 1, 1, "2024-01-01", [(1, 1, 90)]),
    ]
    rows = advanced.customer_qoq_decline(make_star(spark, **DIMENSIONS, **sales(orders))).collect()
    assert [(r.year_num, r.quarter_num, r.order_count_change, int(r.revenue_change)) for r in rows] == [
        (2023, 4, -1, 70)
    ]


def test_high_value_customers_are_above_the_average(spark):
    orders = [
        (1, 1, 1, 1, "2024-01-01", [(1, 2, 30), (2, 2, 30)]),
        (2, 2, 1, 1, "2024-01-01", [(3, 9, 20)]),
        (3, None, 1, 1, "2024-01-01", [(3, 9, 40)]),
    ]
    rows = advanced.products_of_high_value_customers(make_star(spark, **DIMENSIONS, **sales(orders))).collect()
    # The average (40) includes the orders without a customer, as one group. Equal on units and
    # revenue, the products rank by name.
    assert [(r.product_rank, r.product_name) for r in rows] == [(1, "Axe"), (2, "Saw")]


# Tiers


def test_summaries_drop_what_the_base_record_drops(spark):
    products = [*PRODUCTS, {"product_id": 4, "product_name": "Odd", "category_id": None, "unit_cost": 1}]
    orders = [
        (1, 1, 1, 1, "2024-01-01", [(1, 2, 20), (4, 5, 50)]),
        (2, 1, None, 1, "2024-01-01", [(1, 3, 30)]),
        (3, 1, 1, 1, None, [(1, 4, 40)]),
        (4, 2, 1, 1, None, [(2, 4, 40)]),
    ]
    returns = [
        {"return_id": line, "line_item_id": line, "return_date_id": 20240201, "return_quantity": 1,
         "return_reason_code": "DEFECT", "credit_note_value": 3}
        for line in ("1-1", "1-2", "2-1", "3-1", "4-1")
    ]
    star = make_star(
        spark, **{**DIMENSIONS, "dim_products": products}, **sales(orders), fact_returns=returns
    )
    lines = base.base_sales_order_line(star)
    assert set(by(lines, "line_item_id")) == {"1-1"} and len(lines.columns) == 57
    back = base.base_returns(star)
    assert set(by(back, "line_item_id")) == {"1-1", "3-1", "4-1"} and len(back.columns) == 53

    product = by(summaries.sum_product_metrics(star), "product_id")
    assert set(product) == {1}
    # Sales need an order date, returns do not.
    assert (product[1].total_units_sold, product[1].return_rate) == (2, 100.0)
    customer = by(summaries.sum_customer_metrics(star), "customer_id")
    assert set(customer) == {1}
    assert (customer[1].lifetime_revenue, customer[1].order_frequency, customer[1].return_rate) == (20, 1, 100.0)
    assert summaries.sum_monthly_country_sales(star).first().net_revenue == 20
    assert summaries.sum_region_period_sales(star).first().gross_margin_pct == 60.0
    # Nothing was sold in the month of the returns, so they have no rate.
    rates = summaries.sum_returns_metrics(star).collect()
    assert {r.return_rate for r in rates} == {None} and sum(r.returned_units for r in rates) == 3


def test_product_never_returned_has_rate_zero(spark):
    star = make_star(spark, **DIMENSIONS, **sales([(1, 1, 1, 1, "2024-01-01", [(1, 2, 20)])]))
    assert by(summaries.sum_product_metrics(star), "product_id")[1].return_rate == 0.0


def test_identical_quotas_merge_and_multiply_revenue(spark):
    orders = [
        (1, 1, 1, 1, "2024-01-10", [(1, 1, 10)]),
        (2, 1, 1, 1, "2024-01-20", [(1, 1, 20)]),
        (3, 2, 1, 1, "2024-03-20", [(1, 1, 40)]),
    ]
    quotas = [
        quota(1, 1, "2024-01-01", "Monthly", 100),
        quota(2, 1, "2024-01-01", "Monthly", 100),
        quota(3, 1, "2024-01-01", "Quarterly", 100),
        quota(4, 1, "2024-01-01", "Yearly", 100),
        quota(5, 2, "2024-01-01", "Monthly", 100),
        quota(6, 1, "2024-01-01", "Monthly", 0),
    ]
    star = make_star(spark, **DIMENSIONS, **sales(orders), fact_quotas=quotas)
    rows = by(
        summaries.sum_rep_quota_attainment(star), "sales_rep_id", "quota_period_type", "quota_target"
    )
    assert len(rows) == 5
    doubled = rows[1, "Monthly", 100]
    assert (doubled.actual_revenue, doubled.customer_count, doubled.quota_attainment_pct) == (60, 1, 60.0)
    quarter = rows[1, "Quarterly", 100]
    assert (quarter.actual_revenue, quarter.customer_count) == (70, 2)
    # Another period type or no sales: nothing sold. A target of zero: no attainment.
    for key in [(1, "Yearly", 100), (2, "Monthly", 100)]:
        assert (rows[key].actual_revenue, rows[key].customer_count) == (0, 0)
    assert rows[1, "Monthly", 0].quota_attainment_pct is None


def test_scorecard_scopes(spark):
    orders = [
        (1, 1, 1, 1, "2024-01-10", [(1, 1, 10)]),
        (2, 1, 1, 1, "2024-05-10", [(1, 1, 20)]),
        (3, 1, 2, 1, "2024-05-10", [(1, 1, 90)]),
        (4, 1, 1, 1, "2023-05-10", [(1, 1, 500)]),
    ]
    quotas = [
        quota(1, 1, "2024-01-01", "Monthly", 100),
        quota(2, 1, "2024-05-01", "Monthly", 100),
        quota(3, 1, "2024-04-01", "Quarterly", 100),
        quota(4, 2, "2024-04-01", "Quarterly", 100),
        quota(5, 2, "2024-01-01", "Quarterly", 100),
        # Later than any quarterly quota: does not move the quarter.
        quota(6, 2, "2024-08-01", "Monthly", 100),
        quota(7, 1, "2023-05-01", "Monthly", 100),
    ]
    star = make_star(spark, **DIMENSIONS, **sales(orders), fact_quotas=quotas)
    rows = by(reports.rep_performance_scorecard(star), "sales_rep_id", "period_scope")
    assert len(rows) == 4
    current, ytd = rows[1, "CURRENT_QUARTER"], rows[1, "YTD"]
    assert (current.quarter_num, current.month_num, current.quota_attainment_pct) == (2, 4, 20.0)
    assert (current.regional_rank, rows[2, "CURRENT_QUARTER"].regional_rank) == (2, 1)
    assert (ytd.actual_revenue, ytd.quota_target, ytd.quota_attainment_pct) == (30, 200, 15.0)
    # The customer bought in both months and counts in each.
    assert (ytd.customer_count, ytd.quota_period_type, ytd.quarter_num, ytd.month_name) == (2, "YTD", None, None)
    assert (ytd.regional_rank, rows[2, "YTD"].regional_rank) == (1, 2)


def test_customer_360_rep_names(spark):
    orders = [(i, i, 1, 1, "2024-12-01", [(1, 1, 10)]) for i in (1, 2)]
    rows = [
        assignment(1, 1, 1, "2023-01-01"),
        assignment(2, 2, 1, "2024-01-01"),
        assignment(3, 3, 1, "2024-06-01", primary=False),
        assignment(4, 3, 2, "2024-06-01", primary=False),
    ]
    star = make_star(spark, **DIMENSIONS, **sales(orders), rep_customer_assignments=rows)
    found = by(reports.customer_360(star, as_of=AS_OF), "customer_id")
    # A missing last name or rep adds nothing around the space.
    assert found[1].assigned_rep == "Abe " and found[2].assigned_rep == " "
    assert (found[1].recency_days, found[1].rfm_segment) == (30, "Regular")


def test_executive_summary_repeats_the_attainment_of_a_region_name(spark):
    orders = [
        (1, 1, 1, 1, "2024-01-10", [(1, 1, 30)]),
        (2, 1, 1, 2, "2024-01-10", [(1, 1, 20)]),
        (3, 1, 1, 3, "2024-01-10", [(1, 1, 10)]),
    ]
    quotas = [quota(1, 1, "2024-01-01", "Monthly", 100), quota(2, 1, "2024-01-01", "Quarterly", 500)]
    star = make_star(spark, **DIMENSIONS, **sales(orders), fact_quotas=quotas)
    rows = by(reports.sales_executive_summary(star), "region_name", "territory_name")
    # Rep 1 sold 60 in the month and in the quarter: (60 + 60) of 600.
    assert rows["America", "North"].quota_attainment_pct == 20.0
    assert rows["America", None].quota_attainment_pct == 20.0
    assert rows["Africa", "West"].quota_attainment_pct == 0.0


def test_summaries_agree(spark):
    orders = [(i, 1 + i % 2, 1 + i % 3, 1 + i % 3, f"2024-0{1 + i % 9}-05", [(1, 1, i), (2, 1, 2 * i)]) for i in range(40)]
    star = make_star(spark, **DIMENSIONS, **sales(orders))
    total = sum(3 * i for i in range(40))
    assert sum(r.net_revenue for r in summaries.sum_monthly_country_sales(star).collect()) == total
    assert sum(r.total_revenue for r in summaries.sum_region_period_sales(star).collect()) == total
    assert sum(r.lifetime_revenue for r in summaries.sum_customer_metrics(star).collect()) == total
    assert sum(r.net_revenue for r in summaries.sum_product_metrics(star).collect()) == total
    rollup = by(joins.geo_revenue_rollup(star).filter("country_name = 'ALL COUNTRIES'"), "country_name")
    assert rollup["ALL COUNTRIES"].total_revenue == total


# Integrity


def test_null_keys_pass_and_dangling_keys_count(spark):
    customers = [
        {"customer_id": 1, "region_id": 1},
        {"customer_id": 2, "region_id": None},
        {"customer_id": 3, "region_id": 9},
        {"customer_id": 4, "region_id": 9},
    ]
    star = make_star(spark, dim_regions=REGIONS, dim_customers=customers)
    report = by(integrity.referential_integrity_report(star), "constraint_name")
    assert len(report) == 30
    assert (report["fk_customer_region"].checked_rows, report["fk_customer_region"].violations) == (3, 2)
    assert all(row.violations == 0 for name, row in report.items() if name != "fk_customer_region")


def test_repeated_parents_count_their_children_once(spark):
    star = make_star(
        spark,
        dim_regions=[*REGIONS, REGIONS[0], REGIONS[0]],
        dim_customers=[{"customer_id": k, "region_id": 1 + k % 2 * 8} for k in range(5)],
        fact_returns=[{"return_id": 1, "line_item_id": "lost", "return_date_id": 20240101}],
    )
    report = by(integrity.referential_integrity_report(star), "constraint_name")
    assert (report["fk_customer_region"].checked_rows, report["fk_customer_region"].violations) == (5, 2)
    assert (report["fk_return_line"].checked_rows, report["fk_return_line"].violations) == (1, 1)
    assert (report["fk_return_date"].checked_rows, report["fk_return_date"].violations) == (1, 0)
    repeated = report["uq_dim_regions_region_id"]
    assert (repeated.child_table, repeated.checked_rows, repeated.violations) == ("dim_regions", 5, 2)


def test_keys_of_64_neighbours_and_negative_or_large_ones(spark):
    parents = [-(2**63), -65, -64, -1, 0, 63, 64, 2**40, 2**63 - 1, 2**63 - 1]
    keys = [k + d for k in set(parents) for d in (-1, 0, 0, 1) if -(2**63) <= k + d < 2**63]
    star = make_star(
        spark,
        dim_regions=[{"region_id": k} for k in parents],
        dim_customers=[{"customer_id": n, "region_id": k} for n, k in enumerate(keys)],
        fact_order_line_items=[{"line_item_id": k} for k in ("", "0", "a", "a", None)],
        fact_returns=[{"return_id": n, "line_item_id": k} for n, k in enumerate(["", "0", "00", "a", "b", "b", None])],
    )
    report = by(integrity.referential_integrity_report(star), "constraint_name")
    found = {name: (row.checked_rows, row.violations) for name, row in report.items() if row.checked_rows}
    assert found == {
        "fk_customer_region": (len(keys), sum(k not in parents for k in keys)),
        "uq_dim_regions_region_id": (10, 1),
        "uq_dim_customers_customer_id": (len(keys), 0),
        "fk_return_line": (6, 3),
        "uq_fact_order_line_items_line_item_id": (4, 1),
        "uq_dim_date_date_id": (star.dim_date.count(), 0),
    }


# Rules that clean data never breaks


def test_every_order_fault_fires(spark):
    whole = {"customer_id": 1, "sales_rep_id": 1, "order_date_id": 20240101, "net_total": 5}
    faults = {
        "Missing customer": {"customer_id": None},
        "Missing sales rep": {"sales_rep_id": None},
        "Missing date reference": {"order_date_id": None},
        "Missing net total": {"net_total": None},
        "Invalid total": {"net_total": 0},
        "Valid": {},
    }
    orders = [{"order_id": k, **whole, **fault} for k, fault in enumerate(faults.values())]
    rows = by(selection.order_validation(make_star(spark, fact_sales_orders=orders), min_total=None), "order_id")
    assert [rows[k].validation_status for k in range(len(faults))] == list(faults)


def test_margins_round_exact_decimals(spark):
    """Two lines of margin 12.33 and 12.34: their mean is a tie, 12.335, which rounds away from zero."""
    products = [{"product_id": 1, "category_id": 1, "unit_cost": D("87.67")}, {"product_id": 2, "category_id": 1, "unit_cost": D("87.66")}]
    orders = [(1, 1, 1, 1, "2024-01-01", [(1, 1, 100), (2, 1, 100)])]
    star = make_star(spark, **{**DIMENSIONS, "dim_products": products}, **sales(orders))
    [row] = kpi.low_margin_categories(star).collect()
    assert row.avg_gross_margin_pct == D("12.34")


# Tiers on keys without a parent


@pytest.fixture(scope="module")
def full_star(spark):
    rng = random.Random(8)
    orders = [
        (i, 1 + i % 2, 1 + i % 3, 1 + i % 3, f"2024-{1 + i % 12:02d}-05", [(rng.randint(1, 3), rng.randint(1, 9), rng.randint(5, 99)) for _ in range(3)])
        for i in range(60)
    ]
    returns = [
        {"return_id": k, "line_item_id": f"{k}-{1 + k % 3}", "return_date_id": day(f"2024-{1 + k % 12:02d}-20"), "return_quantity": 1,
         "return_reason_code": "DEFECT", "credit_note_value": 3}
        for k in range(0, 60, 2)
    ]
    quotas = [quota(k, 1 + k % 3, f"2024-{1 + k % 12:02d}-01", ["Monthly", "Quarterly"][k % 2], 500, 1 + k % 3) for k in range(12)]
    return make_star(spark, **DIMENSIONS, **sales(orders), fact_returns=returns, fact_quotas=quotas)


@pytest.mark.parametrize("table, gone", [
    ("dim_customers", "customer_id = 2"),
    ("dim_sales_reps", "sales_rep_id = 2"),
    ("dim_products", "product_id = 2"),
    ("dim_categories", "category_id = 2"),
    ("dim_regions", "region_id = 2"),
    ("fact_sales_orders", "order_id % 4 = 1"),
])
def test_summaries_equal_the_grouped_base_record(full_star, table, gone):
    star = replace(full_star, **{table: getattr(full_star, table).filter(f"NOT ({gone})")})
    lines, back, quotas = base.base_sales_order_line(star), base.base_returns(star), base.base_quota_rep_period(star)
    assert lines.count() < full_star.fact_order_line_items.count()

    def grouped(df, *columns):
        return sorted(map(str, ([float(r[c]) if isinstance(r[c], D) else r[c] for c in columns] for r in df.collect())))

    keys = {
        summaries.sum_monthly_country_sales: (["region_country_name", "year_num", "month_num"], "net_revenue"),
        summaries.sum_product_metrics: (["product_id"], "net_revenue"),
        summaries.sum_customer_metrics: (["customer_id"], "lifetime_revenue"),
        summaries.sum_region_period_sales: (["region_name", "territory_name", "year_num", "month_num"], "total_revenue"),
    }
    for summary, (group, revenue) in keys.items():
        wanted = lines.groupBy(*group).agg(F.sum("line_total").alias(revenue))
        assert grouped(summary(star), *group, revenue) == grouped(wanted, *group, revenue), summary.__name__
    rfm = summaries.sum_customer_rfm(star, as_of=date(2024, 12, 31))
    wanted = lines.groupBy("customer_id").agg(F.sum("line_total").alias("monetary_value"), F.countDistinct("order_id").alias("frequency_orders"))
    assert grouped(rfm, "customer_id", "monetary_value", "frequency_orders") == grouped(wanted, "customer_id", "monetary_value", "frequency_orders")
    group = ["category_name", "country_name", "year_num", "month_num"]
    returned = back.groupBy("category_name", "country_name", F.col("return_year_num").alias("year_num"), F.col("return_month_num").alias("month_num"))
    wanted = returned.agg(F.sum("return_quantity").alias("returned_units"))
    assert grouped(summaries.sum_returns_metrics(star), *group, "returned_units") == grouped(wanted, *group, "returned_units")
    attained = by(summaries.sum_rep_quota_attainment(star), "sales_rep_id", "region_id", "date_id", "quota_period_type")
    sold = lines.collect()
    wanted = {}
    for q in quotas.collect():
        period = "month_num" if q.quota_period_type == "Monthly" else "quarter_num"
        total = sum(s.line_total for s in sold if (s.sales_rep_id, s.year_num, s[period]) == (q.sales_rep_id, q.year_num, q[period]))
        wanted[q.sales_rep_id, q.region_id, q.date_id, q.quota_period_type] = total
    assert {k: r.actual_revenue for k, r in attained.items()} == wanted


def test_views_follow_their_tables(spark, full_star):
    """An insert shows in every view, and registering them runs nothing."""
    tables.save_star(full_star, "live", buckets=2)
    try:
        spark.sparkContext.setJobGroup("views", "plans only")
        names = register_views(tables.table_star(spark, "live"), as_of=date(2024, 12, 31))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("views")
        before = {name: sorted(map(str, spark.table(name).collect())) for name in names}
        spark.sql(
            "INSERT INTO live.fact_order_line_items (line_item_id, order_id, product_id, quantity, unit_price, line_total)"
            " VALUES ('new', 0, 1, 1000, 1, 100000)"
        )
        spark.sql(
            "INSERT INTO live.fact_returns (return_id, line_item_id, return_date_id, return_quantity, return_reason_code, credit_note_value)"
            " VALUES (999, '0-1', 20240120, 2, 'DEFECT', 3)"
        )
        spark.sql(
            "INSERT INTO live.fact_quotas (quota_id, sales_rep_id, region_id, date_id, quota_period_type, quota_target)"
            " VALUES (999, 1, 1, 20240101, 'Monthly', 77)"
        )
        stale = [name for name in names if sorted(map(str, spark.table(name).collect())) == before[name]]
        assert not stale
    finally:
        spark.sparkContext.setJobGroup("", "")
        spark.sql("DROP DATABASE live CASCADE")


def test_rollup_levels_tell_members_from_subtotals(spark):
    """The nameless territory of Peru, and a customer without a country, beside the totals above them."""
    orders = [
        (1, 1, 1, 1, "2024-01-01", [(1, 1, 10)]),
        (2, 1, 1, 2, "2024-01-01", [(1, 1, 20)]),
        (3, 3, 1, 3, "2024-01-01", [(1, 1, 40)]),
    ]
    nameless = {"customer_id": 3, "customer_code": "C3", "customer_name": "Cy", "country_name": None, "region_id": 3}
    dimensions = {**DIMENSIONS, "dim_customers": [*DIMENSIONS["dim_customers"], nameless]}
    rows = joins.geo_revenue_levels(make_star(spark, **dimensions, **sales(orders))).collect()
    found = {(r.country_name, r.region_name, r.territory_name, r.rolled_up): int(r.total_revenue) for r in rows}
    assert len(found) == len(rows)
    assert found == {
        (None, None, None, 7): 70,
        (None, None, None, 3): 40,
        (None, "Africa", None, 1): 40,
        (None, "Africa", "West", 0): 40,
        ("Peru", None, None, 3): 30,
        ("Peru", "America", None, 1): 30,
        ("Peru", "America", None, 0): 20,
        ("Peru", "America", "North", 0): 10,
    }
