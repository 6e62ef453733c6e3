"""Tier 3: reports over the summaries."""

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.ratios import percent_ratio
from tradewind.functions.slices import rank_descending, whole
from tradewind.operators.facts import sums
from tradewind.plans.summaries import (
    order_sales,
    period_sales,
    places,
    quota_attainment,
    quota_report,
    region_report,
    rep_months,
    rfm_columns,
    sum_customer_metrics,
    sum_monthly_country_sales,
    sum_product_metrics,
    sum_returns_metrics,
)
from tradewind.star import Star

# Each report is a function of the summaries it reads, so that stored ones serve as well.


def trend(country_sales: DataFrame) -> DataFrame:
    months = Window.partitionBy("region_country_name").orderBy("year_num", "month_num")
    current, previous = F.col("net_revenue"), F.col("previous_month_revenue")
    return (
        country_sales.drop("gross_revenue")
        .withColumn("previous_month_revenue", F.lag(current).over(months))
        .withColumn("revenue_change", current - previous)
        .withColumn("month_over_month_pct_change", percent_ratio(F.col("revenue_change"), previous))
    )


def monthly_trend(star: Star) -> DataFrame:
    return trend(sum_monthly_country_sales(star))


def ranked_products(products: DataFrame) -> DataFrame:
    return rank_descending(products, ["category_id"], "net_revenue", "category_rank")


def product_performance(star: Star) -> DataFrame:
    return ranked_products(sum_product_metrics(star))


def last_period(quotas: DataFrame) -> DataFrame:
    """One row: the latest year with a quota, and the latest quarter of that year with a quarterly one.

    ``quotas`` have ``year_num``, ``quarter_num`` and ``quota_period_type``.
    """
    quarter = F.when(F.col("quota_period_type") == "Quarterly", F.col("quarter_num"))
    latest = quotas.agg(F.max(F.struct("year_num", quarter.alias("quarter"))).alias("last"))
    return latest.select(F.col("last.year_num").alias("year_num"), F.col("last.quarter").alias("last_quarter"))


def rep_performance_scorecard(star: Star) -> DataFrame:
    """Each rep's latest quarter and year to date, ranked by attainment within the quota's region.

    The year is the latest with a quota, the quarter the latest of that year with a quarterly one.
    Year-to-date customers add up the months.
    """
    days = star.calendar("date_id", "year_num", "quarter_num")
    period = last_period(star.assigned_quotas.join(days, "date_id"))
    # Only the days of that year count, and only the lines of their orders are summed.
    year = star.dim_date.join(period, "year_num").drop("last_quarter")
    sales = rep_months(order_sales(star, "net", days=year))
    return scorecard(quota_report(replace(star, dim_date=year), sales), period)


def scorecard(attained: DataFrame, period: DataFrame) -> DataFrame:
    """The scorecard of the quotas in ``period``."""
    # One grouping serves both scopes: a latest-quarter row keeps its period and so stays alone,
    # while the months of the year drop theirs and add up.
    is_quarterly = F.col("quota_period_type") == "Quarterly"
    reported = (F.col("quota_period_type") == "Monthly") | (
        is_quarterly & (F.col("quarter_num") == F.col("last_quarter"))
    )
    rep = [
        "sales_rep_id",
        "employee_code",
        "first_name",
        "last_name",
        "region_id",
        "region_name",
        "country_name",
        "year_num",
    ]
    months = ["quarter_num", "month_num", "month_name"]
    scoped = (
        attained.join(period, "year_num")
        .filter(reported)
        .select(
            *rep,
            *[F.when(is_quarterly, F.col(column)).alias(column) for column in months],
            F.when(is_quarterly, "Quarterly").otherwise("YTD").alias("quota_period_type"),
            F.when(is_quarterly, "CURRENT_QUARTER").otherwise("YTD").alias("period_scope"),
            F.when(is_quarterly, F.col("date_id")).alias("quota_date"),
            F.when(is_quarterly, F.col("quota_target")).alias("quota"),
            "actual_revenue",
            "quota_target",
            "customer_count",
        )
    )
    results = sums(
        scoped,
        [*rep, *months, "quota_period_type", "period_scope", "quota_date", "quota"],
        actual_revenue=F.col("actual_revenue"),
        quota_target=F.col("quota_target"),
        customer_count=F.col("customer_count"),
    )
    attainment = percent_ratio(F.col("actual_revenue"), F.col("quota_target"))
    ranked = rank_descending(
        results.withColumn("quota_attainment_pct", attainment),
        ["region_id", "year_num", "period_scope"],
        "quota_attainment_pct",
        "regional_rank",
    )
    return ranked.select(
        *rep,
        *months,
        "quota_period_type",
        "actual_revenue",
        "quota_target",
        "quota_attainment_pct",
        "customer_count",
        "period_scope",
        "regional_rank",
    )


def customer_360(star: Star, *, as_of: date) -> DataFrame:
    return customer_overview(star, sum_customer_metrics(star), as_of=as_of)


def customer_overview(star: Star, customers: DataFrame, *, as_of: date) -> DataFrame:
    """Customer metrics and segment, from one pass over the sales, with the latest primary rep. An
    unassigned customer's rep is a single space."""
    # One row per customer survives the map side, however many assignments a customer has.
    latest = F.struct("start_date_id", "assignment_id")
    primary = (
        star.rep_customer_assignments.filter("is_primary_rep")
        .groupBy("customer_id")
        .agg(F.max_by("sales_rep_id", latest).alias("sales_rep_id"))
    )
    reps = star.dim_sales_reps.select("sales_rep_id", "first_name", "last_name")
    empty = F.lit("")
    name = F.concat(F.coalesce("first_name", empty), F.lit(" "), F.coalesce("last_name", empty))
    return (
        customers.join(primary, "customer_id", "left")
        .join(reps, "sales_rep_id", "left")
        .select(
            "customer_id",
            "customer_code",
            "customer_name",
            "account_tier",
            "lifetime_revenue",
            "order_frequency",
            "last_order_date",
            "average_order_value",
            "return_rate",
            name.alias("assigned_rep"),
            *rfm_columns(
                F.col("last_order_date"), F.col("order_frequency"), F.col("lifetime_revenue"), as_of
            ),
        )
    )


def returns_analysis(star: Star) -> DataFrame:
    return returns_by_period(sum_returns_metrics(star))


def returns_by_period(returns: DataFrame) -> DataFrame:
    return returns.select(
        "year_num",
        "quarter_num",
        "month_num",
        "country_name",
        "category_name",
        "return_reason_code",
        "returned_units",
        "return_count",
        "total_credit_note_value",
        "return_rate",
    )


def executive_summary(regions: DataFrame, attained: DataFrame) -> DataFrame:
    """``regions`` with the attainment of all quotas of their name and month; zero without quotas."""
    keys = ["region_name", "year_num", "quarter_num", "month_num"]
    quotas = sums(
        attained, keys, actual_revenue=F.col("actual_revenue"), quota_target=F.col("quota_target")
    )
    attainment = percent_ratio(F.col("actual_revenue"), F.col("quota_target"))
    return regions.join(quotas, keys, "left").select(
        *regions.columns, F.coalesce(attainment, F.lit(0.0)).alias("quota_attainment_pct")
    )


def sales_executive_summary(star: Star) -> DataFrame:
    """Region sales by month with the attainment of all quotas of that region name and month; zero
    without quotas.

    Both sides come from one fold of the orders per rep, place and month. An order id counts in the first row
    that it has in a place and month, so that the counts of reps add up to those of distinct orders.
    """
    ids, names = places(star)
    months = ["year_num", "quarter_num", "month_num", "month_name"]
    rows = Window.partitionBy("order_id", "place", *months).orderBy("sales_rep_id")
    orders = order_sales(star, "net", "cost").join(ids, "region_id")
    counted = orders.withColumn("first", F.when(F.row_number().over(rows) == 1, F.col("order_id")))
    sales = whole(
        counted.groupBy("sales_rep_id", "place", *months).agg(
            F.sum("net").alias("revenue"), F.sum("cost").alias("cost"), F.count("first").alias("orders")
        )
    )
    by_place = sums(
        sales,
        ["place", *months],
        revenue=F.col("revenue"),
        cost=F.col("cost"),
        orders=F.col("orders"),
    )
    rep = ["sales_rep_id"]
    per_rep = sums(sales, [*rep, "year_num", "quarter_num", "month_num"], revenue=F.col("revenue"))
    attained = quota_attainment(star, period_sales(per_rep, rep)).join(
        star.dim_regions.select("region_id", "region_name"), "region_id"
    )
    return executive_summary(region_report(by_place.join(names, "place").drop("place")), attained)
