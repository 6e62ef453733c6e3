"""Rankings, period-over-period changes, running totals and segments."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.ratios import ratio, rounded_percent
from tradewind.functions.slices import magnitude, rank_descending, row_number, running_total
from tradewind.operators.facts import latest, sums
from tradewind.star import Star


def top_customer_per_country(star: Star) -> DataFrame:
    """Best customer of each country in the calendar's last year; ties go to the lowest id."""
    in_year = F.col("year_num") == latest(star, "year_num")
    revenue = sums(
        star.fact_sales_orders.select("customer_id", "order_date_id", "net_total").join(
            star.calendar("order_date_id", where=in_year), "order_date_id"
        ),
        ["customer_id"],
        total_revenue=F.col("net_total"),
    )
    customers = star.dim_customers.select("customer_id", "customer_name", "country_name", "account_tier")
    best = Window.partitionBy("country_name").orderBy(F.desc("total_revenue"), "customer_id")
    # Spark keeps only the first row of a country per task before it shuffles for the window.
    return (
        revenue.join(customers, "customer_id")
        .withColumn("place", F.row_number().over(best))
        .filter("place = 1")
        .select("customer_id", "customer_name", "country_name", "account_tier", "total_revenue")
        .orderBy("country_name")
    )


def country_mom_change(star: Star) -> DataFrame:
    """Monthly net order value per region country against the previous month that has orders."""
    monthly = (
        star.fact_sales_orders.select("order_date_id", "region_id", "net_total")
        .join(star.calendar("order_date_id", "year_num", "month_num"), "order_date_id")
        .join(star.dim_regions.select("region_id", "country_name"), "region_id")
        .groupBy("country_name", "year_num", "month_num")
        .agg(F.sum("net_total").alias("monthly_net_revenue"))
    )
    months = Window.partitionBy("country_name").orderBy("year_num", "month_num")
    current, previous = F.col("monthly_net_revenue"), F.col("previous_month_revenue")
    return (
        monthly.withColumn("previous_month_revenue", F.lag(current).over(months))
        .withColumn("revenue_change", current - previous)
        .withColumn("revenue_change_pct", rounded_percent(F.col("revenue_change"), previous))
        .orderBy("country_name", "year_num", "month_num")
    )


def quarter_running_total(star: Star) -> DataFrame:
    """Running net order value within each region name and quarter, order by order."""
    orders = (
        star.fact_sales_orders.select("order_id", "order_date_id", "region_id", "net_total")
        .join(
            star.calendar("order_date_id", "full_date", "year_num", "quarter_num"), "order_date_id"
        )
        .join(star.dim_regions.select("region_id", "region_name"), "region_id")
        .select("order_id", "region_name", "year_num", "quarter_num", "full_date", "net_total")
    )
    quarter = ["region_name", "year_num", "quarter_num"]
    in_order = ["full_date", "order_id"]
    # A slice is a day, and on it a block of order numbers.
    slices = [F.col("full_date"), F.floor(F.col("order_id") / ORDERS_PER_SLICE)]
    running = running_total(orders, quarter, in_order, "net_total", "running_quarter_revenue", slices)
    return running.orderBy(*quarter, *in_order)


def rep_rank_in_region(star: Star) -> DataFrame:
    """Reps ranked by quarterly attainment within their region's name. The quota adds up both
    period types."""
    quarter = ["sales_rep_id", "year_num", "quarter_num"]
    revenue = sums(
        star.fact_sales_orders.select("sales_rep_id", "order_date_id", "net_total").join(
            star.calendar("order_date_id", "year_num", "quarter_num"), "order_date_id"
        ),
        quarter,
        actual_revenue=F.col("net_total"),
    )
    quota = sums(
        star.fact_quotas.select("sales_rep_id", "region_id", "date_id", "quota_target").join(
            star.calendar("date_id", "year_num", "quarter_num"), "date_id"
        ),
        [*quarter, "region_id"],
        quota_target=F.col("quota_target"),
    )
    reps = star.dim_sales_reps.select("sales_rep_id", "first_name", "last_name", "region_id")
    actual, target = F.col("actual_revenue"), F.col("quota_target")
    matched = (
        revenue.join(quota, quarter)
        .join(reps, ["sales_rep_id", "region_id"])
        .join(star.dim_regions.select("region_id", "region_name"), "region_id")
        .select(
            "sales_rep_id",
            "first_name",
            "last_name",
            "region_name",
            "year_num",
            "quarter_num",
            "actual_revenue",
            "quota_target",
            rounded_percent(actual, target).alias("quota_attainment_pct"),
            ratio(actual, target).alias("attainment"),
        )
    )
    ranked = rank_descending(
        matched,
        ["region_name", "year_num", "quarter_num"],
        "attainment",
        "rep_rank_in_region",
    )
    return ranked.drop("attainment").orderBy(
        "region_name", "year_num", "quarter_num", "rep_rank_in_region", "sales_rep_id"
    )


ORDERS_PER_SLICE = 1 << 20


class Rfm(NamedTuple):
    """Limits of one segment; None leaves a limit open."""

    max_recency: int | None = None
    min_recency: int | None = None
    min_orders: int | None = None
    min_value: int | None = None

    def holds(self, recency: Column, orders: Column, value: Column) -> Column:
        tests = []
        if self.max_recency is not None:
            tests.append(recency <= self.max_recency)
        if self.min_recency is not None:
            tests.append(recency > self.min_recency)
        if self.min_orders is not None:
            tests.append(orders >= self.min_orders)
        if self.min_value is not None:
            tests.append(value >= self.min_value)
        held = tests[0]
        for test in tests[1:]:
            held &= test
        return held


# Fixed values
YEARLY_SEGMENTS = {
    "Champions": Rfm(max_recency=30, min_orders=20, min_value=70000),
    "Loyal": Rfm(max_recency=90, min_orders=10, min_value=30000),
    "At Risk": Rfm(min_recency=180, min_orders=10),
    "Lost": Rfm(min_recency=365),
}


def segment(
    limits: dict[str, Rfm], otherwise: str, recency: Column, orders: Column, value: Column
) -> Column:
    """First segment in ``limits`` whose limits all hold."""
    chosen = F
    for name, limit in limits.items():
        chosen = chosen.when(limit.holds(recency, orders, value), name)
    return chosen.otherwise(otherwise)


def customer_rfm_1y(star: Star, *, segments: dict[str, Rfm] = YEARLY_SEGMENTS) -> DataFrame:
    """Segments over the orders of the calendar's last twelve months."""
    today = latest(star, "full_date")
    in_year = F.col("full_date") >= F.add_months(today, -12)
    per_customer = (
        star.fact_sales_orders.select("order_id", "customer_id", "order_date_id", "net_total")
        .join(star.calendar("order_date_id", "full_date", where=in_year), "order_date_id")
        .groupBy("customer_id")
        .agg(
            F.max("full_date").alias("last_order_date"),
            F.count_distinct("order_id").alias("frequency_orders"),
            F.sum("net_total").alias("monetary_value"),
        )
        .withColumn("recency_days", F.datediff(today, "last_order_date"))
    )
    rfm = [F.col("recency_days"), F.col("frequency_orders"), F.col("monetary_value")]
    return (
        per_customer.join(star.dim_customers.select("customer_id", "customer_name"), "customer_id")
        .select(
            "customer_id",
            "customer_name",
            "last_order_date",
            *rfm,
            segment(segments, "New", *rfm).alias("rfm_segment"),
        )
        .orderBy(F.desc("monetary_value"), "customer_id")
    )


def products_never_in_high_rev_regions(star: Star, *, min_revenue: int = 1_000_000) -> DataFrame:
    """Products never sold, at any time, in a region that earned more than ``min_revenue`` in the
    calendar's last twelve months."""
    in_year = F.col("full_date") >= F.add_months(latest(star, "full_date"), -12)
    orders = star.fact_sales_orders.select("order_id", "order_date_id", "region_id", "net_total")
    high_revenue = sums(
        orders.join(star.calendar("order_date_id", where=in_year), "order_date_id"),
        ["region_id"],
        revenue=F.col("net_total"),
    ).filter(F.col("revenue") > min_revenue)
    # Regions are few, so their ids are one array, by which orders are filtered before they meet the lines.
    regions = high_revenue.agg(F.collect_set("region_id").alias("ids")).scalar()
    there = orders.where(F.array_contains(regions, F.col("region_id")))
    sold_there = (
        star.fact_order_line_items.select("order_id", "product_id")
        .join(there.select("order_id"), "order_id", "left_semi")
        .select("product_id")
        .distinct()
    )
    return (
        star.dim_products.select("product_id", "product_name", "category_id")
        .join(sold_there, "product_id", "left_anti")
        .orderBy("product_name", "product_id")
    )


def customer_qoq_decline(star: Star) -> DataFrame:
    """Customer quarters with fewer orders or less value than the customer's previous active one."""
    quarter = ["customer_id", "year_num", "quarter_num"]
    per_quarter = (
        star.fact_sales_orders.select("order_id", "customer_id", "order_date_id", "net_total")
        .join(star.calendar("order_date_id", "year_num", "quarter_num"), "order_date_id")
        .groupBy(*quarter)
        .agg(F.count_distinct("order_id").alias("order_count"), F.sum("net_total").alias("quarter_revenue"))
    )
    # One row per quarter, so a customer's window is as short as the calendar.
    quarters = Window.partitionBy("customer_id").orderBy("year_num", "quarter_num")
    count, revenue = F.col("order_count"), F.col("quarter_revenue")
    earlier_count, earlier_revenue = (
        F.col("previous_quarter_order_count"),
        F.col("previous_quarter_revenue"),
    )
    return (
        per_quarter.withColumn("previous_quarter_order_count", F.lag(count).over(quarters))
        .withColumn("previous_quarter_revenue", F.lag(revenue).over(quarters))
        .filter(
            earlier_count.isNotNull() & ((count < earlier_count) | (revenue < earlier_revenue))
        )
        .join(
            star.dim_customers.select("customer_id", "customer_name", "account_tier"), "customer_id"
        )
        .select(
            "customer_id",
            "customer_name",
            "account_tier",
            "year_num",
            "quarter_num",
            "order_count",
            "previous_quarter_order_count",
            "quarter_revenue",
            "previous_quarter_revenue",
            (count - earlier_count).alias("order_count_change"),
            (revenue - earlier_revenue).alias("revenue_change"),
        )
        .orderBy(F.desc("year_num"), F.desc("quarter_num"), "customer_name", "customer_id")
    )


def _sales_to_high_value_customers(star: Star) -> DataFrame:
    orders = star.fact_sales_orders.select("order_id", "customer_id", "net_total")
    per_customer = sums(orders, ["customer_id"], revenue=F.col("net_total"))
    average = per_customer.agg(F.avg("revenue")).scalar()
    high_value = per_customer.filter(F.col("revenue") > average)
    # The negated key is not the one the aggregate is partitioned by: Spark shuffles both sides of the
    # join for it, and so can split the orders of a busy customer.
    key = F.negate("customer_id").alias("customer_id")
    their_orders = orders.select("order_id", key).join(high_value.select(key), "customer_id", "left_semi")
    lines = star.fact_order_line_items.select("order_id", "product_id", "quantity", "line_total")
    return sums(
        lines.join(their_orders.select("order_id"), "order_id", "left_semi"),
        ["product_id"],
        total_quantity_sold=F.col("quantity"),
        total_revenue=F.col("line_total"),
    )


def products_of_high_value_customers(star: Star) -> DataFrame:
    """Products by units sold to customers whose total order value is above the average customer's."""
    sold = _sales_to_high_value_customers(star).join(
        star.dim_products.select("product_id", "product_name"), "product_id"
    )
    # Products that sold more units come first, whichever they are; among those of one quantity, which may be a
    # large share of all, revenue decides.
    ahead = rank_descending(sold, [], "total_quantity_sold", "ahead")
    order = [F.desc("total_revenue"), F.col("product_name"), F.col("product_id")]
    return (
        row_number(
            ahead, ["total_quantity_sold"], order, "within", [magnitude("total_revenue")], descending=True
        )
        .withColumn("product_rank", F.col("ahead") + F.col("within") - 1)
        .select("product_rank", "product_id", "product_name", "total_quantity_sold", "total_revenue")
        .orderBy("product_rank")
    )
