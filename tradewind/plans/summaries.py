"""Tier 2: summaries of the base records.

Each gives what grouping the wide tier 1 record would give, but reads only the tables whose columns
it reports: lines fold per order, customer or product first and meet large dimensions as one row
per key. Dimensions that contribute no column are only looked up, by orders, as ``Star`` states.
"""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.ratios import percent_ratio, ratio
from tradewind.operators.advanced import Rfm, segment
from tradewind.operators.facts import named, sums
from tradewind.star import Star

# Fixed values
LIFETIME_SEGMENTS = {
    "Champions": Rfm(max_recency=30, min_orders=10, min_value=10000),
    "Loyal": Rfm(max_recency=60, min_orders=5, min_value=5000),
    "New": Rfm(max_recency=90, min_orders=3),
    "At Risk": Rfm(min_recency=180, min_orders=5),
    "Lost": Rfm(min_recency=180),
}

_PERIOD = ["sales_rep_id", "quota_period_type", "year_num", "period_num"]
_MONTHS = ["year_num", "quarter_num", "month_num", "month_name"]
_MEASURES = {
    "gross": "quantity * unit_price",
    "net": "line_total",
    "units": "quantity",
    "cost": "quantity * unit_cost",
}


def order_sales(star: Star, *measures: str, days: DataFrame | None = None) -> DataFrame:
    """Sold orders with their keys, their day and sums of their lines, one row each.

    All summaries of sales follow from these rows. An order id that occurs on several rows stays on
    several rows here, and summaries count it once in each of their groups. ``days``, a part of the calendar, limits
    the orders; lines then meet them before they are summed, so that only those of the days are.
    """
    keys = ["order_id", "order_date_id", "region_id", "customer_id", "sales_rep_id"]
    calendar = star.dim_date if days is None else days
    dates = calendar.select(F.col("date_id").alias("order_date_id"), "full_date", *_MONTHS)
    orders = star.returnable_orders.select(*keys).join(dates, "order_date_id")
    lines = star.sold_lines if days is None else star.sold_lines_by_bits
    if "cost" in measures:
        lines = star.fact_order_line_items.join(star.sold_products.select("product_id", "unit_cost"), "product_id")
    folded = {name: F.expr(_MEASURES[name]) for name in measures}
    if days is not None:
        return sums(lines.join(orders, "order_id"), orders.columns, **folded)
    return orders.join(sums(lines, ["order_id"], **folded), "order_id")


def country_months(star: Star, orders: DataFrame) -> DataFrame:
    return (
        orders.join(
            star.dim_regions.select("region_id", F.col("country_name").alias("region_country_name")),
            "region_id",
        )
        .groupBy("region_country_name", "year_num", "month_num", "month_name")
        .agg(
            F.sum("gross").alias("gross_revenue"),
            F.sum("net").alias("net_revenue"),
            F.count_distinct("order_id").alias("order_count"),
        )
    )


def country_report(months: DataFrame) -> DataFrame:
    """``country_months`` with the average order value."""
    return months.withColumn("average_order_value", ratio(F.col("net_revenue"), F.col("order_count")))


def sum_monthly_country_sales(star: Star) -> DataFrame:
    return country_report(country_months(star, order_sales(star, "gross", "net")))


def _returned_lines(star: Star) -> DataFrame:
    """Lines with returns, one row each, with the units returned."""
    per_line = sums(
        star.fact_returns.join(star.calendar("return_date_id"), "return_date_id", "left_semi"),
        ["line_item_id"],
        returned_units=F.col("return_quantity"),
    )
    return star.sold_lines.select("line_item_id", "order_id", "product_id").join(per_line, "line_item_id")


def _return_rate(units: Column) -> Column:
    return percent_ratio(F.coalesce("returned_units", F.lit(0)), units)


def product_report(star: Star, sold: DataFrame, returned: DataFrame) -> DataFrame:
    """Products with their units and revenue in ``sold`` and their units in ``returned``."""
    products = star.dim_products.select(
        "product_id", "sku", "product_name", "category_id", "unit_cost"
    ).join(star.dim_categories.select("category_id", "category_name"), "category_id")
    units, revenue = F.col("total_units_sold"), F.col("net_revenue")
    return (
        sums(sold, ["product_id"], total_units_sold=F.col("units"), net_revenue=F.col("net"))
        .join(sums(returned, ["product_id"], returned_units=F.col("returned_units")), "product_id", "left")
        .join(products, "product_id")
        .select(
            "product_id",
            "sku",
            "product_name",
            "category_id",
            "category_name",
            "total_units_sold",
            "net_revenue",
            percent_ratio(revenue - units * F.col("unit_cost"), revenue).alias("gross_margin_pct"),
            _return_rate(units).alias("return_rate"),
        )
    )


def product_sales(star: Star) -> DataFrame:
    """Lines of sold orders by product."""
    return star.sold_lines.join(star.sold_orders.select("order_id"), "order_id").select(
        "product_id", F.col("quantity").alias("units"), F.col("line_total").alias("net")
    )


def sum_product_metrics(star: Star) -> DataFrame:
    returned = _returned_lines(star).join(star.returnable_orders.select("order_id"), "order_id")
    return product_report(star, product_sales(star), returned)


def _customer_sales(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        F.sum("net").alias("revenue"),
        F.sum("units").alias("units"),
        F.count_distinct("order_id").alias("orders"),
        F.max("full_date").alias("last_order_date"),
    )


def _with_customer(star: Star, sales: DataFrame, *columns: str) -> DataFrame:
    return sales.join(
        star.dim_customers.select("customer_id", "customer_code", "customer_name", *columns),
        "customer_id",
    )


def customer_returns(star: Star) -> DataFrame:
    """Units returned by order and customer."""
    return sums(_returned_lines(star), ["order_id"], returned_units=F.col("returned_units")).join(
        star.returnable_orders.select("order_id", "customer_id"), "order_id"
    )


def customer_report(star: Star, orders: DataFrame, returned: DataFrame) -> DataFrame:
    """Customers with their ``order_sales`` and their units in ``returned``."""
    back = sums(returned, ["customer_id"], returned_units=F.col("returned_units"))
    sales = _customer_sales(orders).join(back, "customer_id", "left")
    revenue, count = F.col("revenue"), F.col("orders")
    return _with_customer(star, sales, "account_tier").select(
        "customer_id",
        "customer_code",
        "customer_name",
        "account_tier",
        revenue.alias("lifetime_revenue"),
        count.alias("order_frequency"),
        "last_order_date",
        ratio(revenue, count).alias("average_order_value"),
        _return_rate(F.col("units")).alias("return_rate"),
    )


def sum_customer_metrics(star: Star) -> DataFrame:
    return customer_report(star, order_sales(star, "units", "net"), customer_returns(star))


def rfm_columns(last_order: Column, orders: Column, value: Column, as_of: date) -> list[Column]:
    """Recency, frequency, value and segment at ``as_of``."""
    recency = F.datediff(F.lit(as_of), last_order)
    return [
        recency.alias("recency_days"),
        orders.alias("frequency_orders"),
        value.alias("monetary_value"),
        segment(LIFETIME_SEGMENTS, "Regular", recency, orders, value).alias("rfm_segment"),
    ]


def rfm_report(star: Star, orders: DataFrame, *, as_of: date) -> DataFrame:
    """Customers with their recency, frequency and value in ``order_sales``."""
    rfm = rfm_columns(F.col("last_order_date"), F.col("orders"), F.col("revenue"), as_of)
    return _with_customer(star, _customer_sales(orders)).select(
        "customer_id", "customer_code", "customer_name", *rfm
    )


def sum_customer_rfm(star: Star, *, as_of: date) -> DataFrame:
    return rfm_report(star, order_sales(star, "units", "net"), as_of=as_of)


def period_sales(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Each rep's revenue by month and by quarter, told apart by the quota type they answer to.

    ``monthly`` has one row per ``keys`` and month, with the rep among the keys. With the customer as
    the other key, ``customers`` counts the distinct customers of each period.
    """
    quarterly = sums(monthly, [*keys, "year_num", "quarter_num"], revenue=F.col("revenue"))
    return (
        _typed_period(monthly, "Monthly", "month_num")
        .unionByName(_typed_period(quarterly, "Quarterly", "quarter_num"))
        .groupBy(*_PERIOD)
        .agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("customers"))
    )


def _typed_period(sales: DataFrame, period_type: str, column: str) -> DataFrame:
    return sales.select(
        "sales_rep_id",
        F.lit(period_type).alias("quota_period_type"),
        "year_num",
        F.col(column).alias("period_num"),
        "revenue",
    )


def quota_attainment(star: Star, sales: DataFrame) -> DataFrame:
    """Quotas by rep, region, date, type and target with the rep's ``period_sales``.

    Monthly quotas meet the rep's sales of their month, quarterly ones those of their quarter, any
    other type none. Identical quotas are one row whose revenue counts once per quota, while
    customers are distinct in any case. One equi-join on (rep, type, year, period) serves both
    types.
    """
    quota_keys = ["sales_rep_id", "region_id", "date_id", "quota_period_type", "quota_target"]
    period_num = F.when(F.col("quota_period_type") == "Monthly", F.col("month_num")).when(
        F.col("quota_period_type") == "Quarterly", F.col("quarter_num")
    )
    quotas = (
        star.assigned_quotas.groupBy(*quota_keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(star.calendar("date_id", "full_date", *_MONTHS), "date_id")
        .withColumn("period_num", period_num)
    )
    revenue = F.coalesce(F.col("revenue") * F.col("copies"), F.lit(0))
    return quotas.join(sales, _PERIOD, "left").select(
        *quota_keys,
        "full_date",
        *_MONTHS,
        revenue.cast("decimal(28,2)").alias("actual_revenue"),
        F.coalesce("customers", F.lit(0)).alias("customer_count"),
    )


def rep_months(orders: DataFrame) -> DataFrame:
    """Revenue of ``order_sales`` by rep, customer and month."""
    keys = ["sales_rep_id", "customer_id", "year_num", "quarter_num", "month_num"]
    return sums(orders, keys, revenue=F.col("net"))


def quota_report(star: Star, monthly: DataFrame) -> DataFrame:
    """Quotas with the attainment that ``rep_months`` give."""
    reps = star.dim_sales_reps.select("sales_rep_id", "employee_code", "first_name", "last_name")
    return (
        quota_attainment(star, period_sales(monthly, ["sales_rep_id", "customer_id"]))
        .join(star.dim_regions.select("region_id", "region_name", "country_name"), "region_id")
        .join(reps, "sales_rep_id")
        .select(
            "sales_rep_id",
            "employee_code",
            "first_name",
            "last_name",
            "region_id",
            "region_name",
            "country_name",
            "date_id",
            "full_date",
            *_MONTHS,
            "quota_period_type",
            "quota_target",
            "actual_revenue",
            "customer_count",
            percent_ratio(F.col("actual_revenue"), F.col("quota_target")).alias("quota_attainment_pct"),
        )
    )


def sum_rep_quota_attainment(star: Star) -> DataFrame:
    return quota_report(star, rep_months(order_sales(star, "net")))


_PLACE_MONTH = ["category_name", "country_name", "year_num", "quarter_num", "month_num"]


def _categories(star: Star) -> DataFrame:
    return star.dim_products.select("product_id", "category_id").join(
        star.dim_categories.select("category_id", "category_name"), "category_id"
    )


def sold_units(star: Star) -> DataFrame:
    """Units sold by category name, country of the order's region and month."""
    # Units fold per order and category, so that each order meets few rows.
    lines = star.fact_order_line_items.select("order_id", "product_id", "quantity").join(_categories(star), "product_id")
    return sums(
        sums(lines, ["order_id", "category_name"], units=F.col("quantity"))
        .join(star.sold_orders.select("order_id", "order_date_id", "region_id"), "order_id")
        .join(star.calendar("order_date_id", "year_num", "quarter_num", "month_num"), "order_date_id")
        .join(star.dim_regions.select("region_id", "country_name"), "region_id"),
        _PLACE_MONTH,
        sold_units=F.col("units"),
    )


def returned_products(star: Star) -> DataFrame:
    """Returns by product, region of the order, month of the return and reason."""
    periods = ["year_num", "quarter_num", "month_num"]
    returned = (
        star.fact_returns.join(star.calendar("return_date_id", *periods), "return_date_id")
        .join(star.fact_order_line_items.select("line_item_id", "order_id", "product_id"), "line_item_id")
        .join(star.returnable_orders.select("order_id", "region_id"), "order_id")
    )
    return returned.groupBy("product_id", "region_id", *periods, "return_reason_code").agg(
        F.sum("return_quantity").alias("returned_units"),
        F.count("return_id").alias("return_count"),
        F.sum("credit_note_value").alias("total_credit_note_value"),
    )


def returns_report(star: Star, returned: DataFrame, sold: DataFrame) -> DataFrame:
    """``returned_products`` by category and country against the ``sold_units`` of their month."""
    metrics = (
        returned.join(_categories(star), "product_id")
        .join(star.dim_regions.select("region_id", "country_name"), "region_id")
        .groupBy(*_PLACE_MONTH, "return_reason_code")
        .agg(
            F.sum("returned_units").alias("returned_units"),
            F.sum("return_count").alias("return_count"),
            F.sum("total_credit_note_value").alias("total_credit_note_value"),
        )
    )
    rate = percent_ratio(F.col("returned_units"), F.col("sold_units"))
    return metrics.join(sold, _PLACE_MONTH, "left").select(
        *_PLACE_MONTH,
        "return_reason_code",
        "returned_units",
        "return_count",
        "total_credit_note_value",
        rate.alias("return_rate"),
    )


def sum_returns_metrics(star: Star) -> DataFrame:
    """Returns by category name, region country, return month and reason, against the units of that
    category, country and month that were sold."""
    return returns_report(star, returned_products(star), sold_units(star))


def places(star: Star) -> tuple[DataFrame, DataFrame]:
    """(region_id, place) and the names of each place: regions alike in their three names are one."""
    regions = star.dim_regions.withColumnRenamed("country_name", "region_country_name")
    return named(regions, "region_id", ["region_name", "region_country_name", "territory_name"], "place")


def place_months(star: Star, orders: DataFrame) -> DataFrame:
    """Revenue, cost and distinct orders of ``order_sales`` by place and month."""
    ids, names = places(star)
    months = (
        orders.join(ids, "region_id")
        .groupBy("place", *_MONTHS)
        .agg(
            F.sum("net").alias("revenue"),
            F.sum("cost").alias("cost"),
            F.count_distinct("order_id").alias("orders"),
        )
    )
    return months.join(names, "place").drop("place")


def region_report(months: DataFrame) -> DataFrame:
    """``place_months`` with margin and average order value."""
    revenue, orders = F.col("revenue"), F.col("orders")
    return months.select(
        "region_name",
        "region_country_name",
        "territory_name",
        *_MONTHS,
        revenue.alias("total_revenue"),
        percent_ratio(revenue - F.col("cost"), revenue).alias("gross_margin_pct"),
        orders.alias("order_count"),
        ratio(revenue, orders).alias("average_order_value"),
    )


def sum_region_period_sales(star: Star) -> DataFrame:
    return region_report(place_months(star, order_sales(star, "net", "cost")))
