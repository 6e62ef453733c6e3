"""Standing business questions."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.ratios import percent_ratio
from tradewind.operators.facts import last_full_year
from tradewind.star import Star


def gold_customers_by_country(
    star: Star, *, country: str = "Germany", tier: str = "Gold", min_credit: int = 5000
) -> DataFrame:
    wanted = (
        (F.col("country_name") == country)
        & (F.col("account_tier") == tier)
        & (F.col("credit_limit") > min_credit)
    )
    return (
        star.dim_customers.filter(wanted)
        .orderBy(F.desc("credit_limit"), "customer_name", "customer_id")
        .select("customer_name", "country_name", "account_tier", "credit_limit")
    )


def open_orders_q3_last_full_year(
    star: Star,
    *,
    as_of: date,
    quarter: int = 3,
    statuses: tuple[str, ...] = ("Pending", "Partially Delivered"),
) -> DataFrame:
    in_quarter = (F.col("year_num") == last_full_year(star, as_of)) & (F.col("quarter_num") == quarter)
    dates = star.calendar("order_date_id", F.col("full_date").alias("order_date"), where=in_quarter)
    return (
        star.fact_sales_orders.filter(F.col("order_status").isin(*statuses))
        .select("customer_id", "order_date_id", F.col("net_total").alias("total_value"))
        .join(dates, "order_date_id")
        .join(star.dim_customers.select("customer_id", "customer_name"), "customer_id")
        .select("customer_name", "order_date", "total_value")
    )


def margin_over_3x(star: Star, *, multiple: int = 3) -> DataFrame:
    price, cost = F.col("list_price"), F.col("unit_cost")
    return (
        star.dim_products.filter(price > cost * multiple)
        .withColumn("margin_percentage", percent_ratio(price - cost, price))
        .orderBy(F.desc("margin_percentage"), "product_name", "product_id")
        .select("product_name", "unit_cost", "list_price", "margin_percentage")
    )


def _recent_dates(star: Star, as_of: date, months: int) -> DataFrame:
    cutoff = F.add_months(F.lit(as_of), -months)
    return star.calendar("start_date_id", where=F.col("full_date") >= cutoff)


def reps_without_recent_assignment(star: Star, *, as_of: date, months: int = 6) -> DataFrame:
    """One row per assignment that did not start recently, and one per rep never assigned.

    A rep with both recent and older assignments therefore still appears; see
    ``unassigned_reps`` for the reps with no recent assignment at all.
    """
    assignments = star.rep_customer_assignments.select("sales_rep_id", "start_date_id")
    reps = star.dim_sales_reps.select("sales_rep_id", "first_name", "last_name", "email")
    stale = assignments.join(_recent_dates(star, as_of, months), "start_date_id", "left_anti")
    # An outer join cannot split a busy rep's assignments over tasks; these two joins can.
    per_assignment = stale.join(reps, "sales_rep_id").select(*reps.columns)
    never = reps.join(assignments.select("sales_rep_id").distinct(), "sales_rep_id", "left_anti")
    return per_assignment.unionByName(never)


def unassigned_reps(star: Star, *, as_of: date, months: int = 6) -> DataFrame:
    """Reps with no assignment that started in the last ``months`` months, one row each."""
    assigned = (
        star.rep_customer_assignments.select("sales_rep_id", "start_date_id")
        .join(_recent_dates(star, as_of, months), "start_date_id", "left_semi")
        .select("sales_rep_id")
        .distinct()
    )
    reps = star.dim_sales_reps.select("sales_rep_id", "first_name", "last_name", "email")
    return reps.join(assigned, "sales_rep_id", "left_anti")


def delayed_shipments(star: Star, *, country: str = "Germany", days: int = 14) -> DataFrame:
    ordered = star.calendar("order_date_id", F.col("full_date").alias("order_date"))
    shipped = star.calendar("shipping_date_id", F.col("full_date").alias("shipping_date"))
    customers = star.dim_customers.filter(F.col("country_name") == country)
    return (
        star.fact_sales_orders.select("order_number", "customer_id", "order_date_id", "shipping_date_id")
        .join(ordered, "order_date_id")
        .join(shipped, "shipping_date_id")
        .filter(F.datediff("shipping_date", "order_date") > days)
        .join(customers.select("customer_id", "customer_name", "country_name"), "customer_id")
        .select("order_number", "customer_name", "country_name", "order_date", "shipping_date")
    )


def product_keyword_search(
    star: Star, *, keywords: tuple[str, ...] = ("pro", "plus", "max")
) -> DataFrame:
    name = F.lower("product_name")
    found = F.lit(False)
    for keyword in keywords:
        found |= name.contains(keyword.lower())
    return star.dim_products.filter(found)
