"""Revenue, margin, quota and customer KPIs."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.ratios import percent, quotient, rounded_percent
from tradewind.operators.facts import last_full_year, per_order, sums
from tradewind.star import Star


def gross_rev_month_customer_country(star: Star) -> DataFrame:
    """Revenue before discounts by month and the customer's country."""
    gross = per_order(star, gross_revenue=F.col("quantity") * F.col("unit_price"))
    orders = (
        star.fact_sales_orders.select("order_id", "order_date_id", "customer_id")
        .join(gross, "order_id")
        .join(star.calendar("order_date_id", "year_num", "month_num"), "order_date_id")
    )
    per_customer = sums(
        orders, ["customer_id", "year_num", "month_num"], gross_revenue=F.col("gross_revenue")
    )
    return (
        per_customer.join(star.dim_customers.select("customer_id", "country_name"), "customer_id")
        .groupBy("year_num", "month_num", "country_name")
        .agg(F.sum("gross_revenue").alias("gross_revenue"))
        .orderBy("year_num", "month_num", "country_name")
    )


def net_rev_by_quarter(star: Star) -> DataFrame:
    """Revenue after discounts by quarter of the year, all years together."""
    net = per_order(
        star, net_revenue=F.col("quantity") * F.col("unit_price") - F.col("discount_amount")
    )
    return (
        star.fact_sales_orders.select("order_id", "order_date_id")
        .join(net, "order_id")
        .join(star.calendar("order_date_id", "quarter_num"), "order_date_id")
        .groupBy("quarter_num")
        .agg(F.sum("net_revenue").alias("net_revenue"))
        .orderBy("quarter_num")
    )


def product_gross_margin(star: Star) -> DataFrame:
    """A product has one unit cost, so its cost is that times the units sold."""
    sold = sums(
        star.fact_order_line_items,
        ["product_id"],
        units=F.col("quantity"),
        # Units of lines that also carry a total, for the profit over those lines.
        totalled_units=F.when(F.col("line_total").isNotNull(), F.col("quantity")),
        totalled=F.when(F.col("quantity").isNotNull(), F.col("line_total")),
        total_revenue=F.col("line_total"),
    )
    cost = F.col("unit_cost")
    profit = F.col("totalled") - F.col("totalled_units") * cost
    return (
        sold.join(star.dim_products.select("product_id", "product_name", "unit_cost"), "product_id")
        .select(
            "product_id",
            "product_name",
            "total_revenue",
            (F.col("units") * cost).alias("total_cost"),
            profit.alias("gross_profit"),
            rounded_percent(profit, F.col("total_revenue")).alias("gross_margin_pct"),
        )
        .orderBy(F.desc("gross_margin_pct"), "product_id")
    )


def _monthly_actuals_and_targets(star: Star) -> DataFrame:
    period = ["sales_rep_id", "year_num", "month_num"]
    orders = (
        star.fact_sales_orders.select("sales_rep_id", "order_date_id", "net_total")
        .join(star.calendar("order_date_id", "year_num", "month_num"), "order_date_id")
        .groupBy(*period)
        .agg(F.sum("net_total").alias("actual"), F.count(F.lit(1)).alias("orders"))
    )
    quotas = (
        star.fact_quotas.filter(F.col("quota_period_type") == "Monthly")
        .select("sales_rep_id", "date_id", "quota_target")
        .join(star.calendar("date_id", "year_num", "month_num"), "date_id")
        .groupBy(*period)
        .agg(F.sum("quota_target").alias("target"), F.count(F.lit(1)).alias("quotas"))
    )
    return orders.join(quotas, period).join(
        star.dim_sales_reps.select("sales_rep_id", "first_name", "last_name"), "sales_rep_id"
    )


def _attainment(matched: DataFrame, actual, target) -> DataFrame:
    return matched.select(
        "sales_rep_id",
        "first_name",
        "last_name",
        "year_num",
        "month_num",
        actual.alias("actual_revenue"),
        target.alias("total_quota_target"),
        rounded_percent(actual, target).alias("quota_attainment_pct"),
    ).orderBy("sales_rep_id", "year_num", "month_num")


def quota_attainment_monthly(star: Star) -> DataFrame:
    """Every order meets every quota of its rep and month, so revenue counts once per quota and
    targets once per order. The same sums come from multiplying the two sides' sums and counts,
    without forming the pairs. See ``quota_attainment_once`` for each counted once."""
    return _attainment(
        _monthly_actuals_and_targets(star),
        F.col("actual") * F.col("quotas"),
        F.col("target") * F.col("orders"),
    )


def quota_attainment_once(star: Star) -> DataFrame:
    """Monthly net order value against the monthly quota, each counted once."""
    return _attainment(_monthly_actuals_and_targets(star), F.col("actual"), F.col("target"))


def _rep_quarter_revenue(star: Star, min_revenue: int) -> DataFrame:
    revenue = per_order(star, net_revenue=F.col("line_total"))
    return (
        star.fact_sales_orders.select("order_id", "order_date_id", "sales_rep_id")
        .join(revenue, "order_id")
        .join(star.calendar("order_date_id", "year_num", "quarter_num"), "order_date_id")
        .groupBy("sales_rep_id", "year_num", "quarter_num")
        .agg(F.sum("net_revenue").alias("net_revenue"))
        .filter(F.col("net_revenue") > min_revenue)
    )


def rep_quarter_high_revenue(star: Star, *, min_revenue: int = 50000) -> DataFrame:
    reps = star.dim_sales_reps.select("sales_rep_id", "first_name", "last_name")
    return (
        _rep_quarter_revenue(star, min_revenue)
        .join(reps, "sales_rep_id")
        .select(
            "year_num",
            "quarter_num",
            "sales_rep_id",
            "first_name",
            "last_name",
            F.round("net_revenue", 2).alias("net_revenue"),
        )
        .orderBy("year_num", "quarter_num", F.desc("net_revenue"), "sales_rep_id")
    )


def rep_quarter_below_quota(
    star: Star, *, min_revenue: int = 500_000, max_attainment: int = 80
) -> DataFrame:
    """High-revenue rep quarters whose revenue is under ``max_attainment`` % of the quarterly quota."""
    quotas = (
        star.fact_quotas.filter(F.col("quota_period_type") == "Quarterly")
        .select("sales_rep_id", "date_id", "quota_target")
        .join(star.calendar("date_id", "year_num", "quarter_num"), "date_id")
        .groupBy("sales_rep_id", "year_num", "quarter_num")
        .agg(F.sum("quota_target").alias("quota_target"))
    )
    revenue, target = F.col("net_revenue"), F.col("quota_target")
    return (
        _rep_quarter_revenue(star, min_revenue)
        .join(quotas, ["sales_rep_id", "year_num", "quarter_num"])
        .filter(percent(revenue, target) < max_attainment)
        .join(star.dim_sales_reps.select("sales_rep_id", "first_name", "last_name"), "sales_rep_id")
        .select(
            "year_num",
            "quarter_num",
            "sales_rep_id",
            "first_name",
            "last_name",
            "net_revenue",
            "quota_target",
            rounded_percent(revenue, target).alias("quota_attainment_pct"),
        )
        .orderBy("year_num", "quarter_num", F.desc("net_revenue"), "sales_rep_id")
    )


def _per_product(star: Star) -> DataFrame:
    """What a category's mean line margin needs of each product's lines.

    A line's margin is 100 - 100 * unit cost * quantity / total, so the count of lines and the sum of
    quantity / total are enough. A line without a total has no margin.
    """
    units_per_money = quotient(F.col("quantity"), F.col("line_total"), "decimal(24,14)")
    return star.fact_order_line_items.groupBy("product_id").agg(
        F.count(units_per_money).alias("lines"),
        F.sum(units_per_money).alias("units_per_money"),
        F.sum("quantity").alias("units"),
    )


def _mean_margin() -> Column:
    cost = F.col("unit_cost").cast("decimal(12,2)")
    lines = F.when(F.col("unit_cost").isNotNull(), F.col("lines"))
    cost_per_money = F.sum(cost * F.col("units_per_money").cast("decimal(24,14)")).cast("decimal(28,16)")
    share = cost_per_money / F.nullif(F.sum(lines), F.lit(0)).cast("decimal(18,0)")
    return 100 - share.cast("decimal(28,14)") * 100


def low_margin_categories(star: Star, *, max_margin: int = 25) -> DataFrame:
    products = star.dim_products.select("product_id", "category_id", "unit_cost")
    return (
        _per_product(star)
        .join(products, "product_id")
        .groupBy("category_id")
        .agg(_mean_margin().alias("margin"))
        .filter(F.col("margin") < max_margin)
        .select("category_id", F.round("margin", 2).alias("avg_gross_margin_pct"))
        .orderBy("category_id")
    )


def low_margin_high_return_categories(
    star: Star, *, max_margin: int = 25, min_return_rate: float = 10
) -> DataFrame:
    """Low-margin categories of which more than ``min_return_rate`` % of the units came back."""
    per_line = sums(star.fact_returns, ["line_item_id"], returned=F.col("return_quantity"))
    returned = sums(
        star.fact_order_line_items.select("line_item_id", "product_id").join(per_line, "line_item_id"),
        ["product_id"],
        returned=F.col("returned"),
    )
    rate = percent(F.col("returned"), F.col("units"))
    return (
        _per_product(star)
        .join(returned, "product_id", "left")
        .join(star.dim_products.select("product_id", "category_id", "unit_cost"), "product_id")
        .groupBy("category_id")
        .agg(
            _mean_margin().alias("margin"),
            F.sum("units").alias("units"),
            F.coalesce(F.sum("returned"), F.lit(0)).alias("returned"),
        )
        .filter((F.col("margin") < max_margin) & (rate > min_return_rate))
        .select(
            "category_id",
            F.round("margin", 2).alias("avg_gross_margin_pct"),
            F.round(rate, 2).alias("return_rate_pct"),
        )
        .orderBy("category_id")
    )


def frequent_low_value_customers(
    star: Star, *, as_of: date, min_orders: int = 10, max_order_value: int = 5000
) -> DataFrame:
    """Customers with more than ``min_orders`` orders in the last full year, worth less than
    ``max_order_value`` on average."""
    in_year = F.col("year_num") == last_full_year(star, as_of)
    orders = star.fact_sales_orders.select("order_id", "order_date_id", "customer_id").join(
        star.calendar("order_date_id", where=in_year), "order_date_id"
    )
    # The year's orders pick their lines before these fold.
    lines = star.fact_order_line_items.join(orders.select("order_id"), "order_id", "left_semi")
    per_customer = (
        orders.join(sums(lines, ["order_id"], value=F.col("line_total")), "order_id")
        .groupBy("customer_id")
        .agg(F.count_distinct("order_id").alias("total_orders"), F.sum("value").alias("value"))
    )
    # value / orders < limit, without rounding the quotient.
    frequent = (F.col("total_orders") > min_orders) & (
        F.col("value") < F.col("total_orders") * max_order_value
    )
    return (
        per_customer.filter(frequent)
        .join(star.dim_customers.select("customer_id", "customer_name"), "customer_id")
        .select(
            "customer_id",
            "customer_name",
            "total_orders",
            quotient(F.col("value"), F.col("total_orders"), "decimal(18,2)").alias("average_order_value"),
        )
        .orderBy(F.desc("total_orders"), "customer_id")
    )
