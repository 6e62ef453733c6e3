"""Selection, profiling and row validation."""

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.ratios import percent, quotient, rounded_percent
from tradewind.functions.slices import rank_descending
from tradewind.operators.facts import per_order
from tradewind.star import Star

# Fixed values
CUSTOMER_FAULTS = [
    "Missing customer code",
    "Missing customer name",
    "Missing country",
    "Missing credit limit",
    "Invalid credit limit",
]
ORDER_FAULTS = [
    "Missing customer",
    "Missing sales rep",
    "Missing date reference",
    "Missing net total",
    "Invalid total",
]
FAULTLESS = "Valid"
MARGIN_BANDS = ["High Margin", "Medium Margin", "Low Margin"]
DISCOUNT_LEVELS = ["High Discount", "Medium Discount", "Low Discount"]


def _banded(tests: list[Column], labels: list[str]) -> Column:
    """Label of the first test that holds; the last label if none does."""
    chosen = F
    for test, label in zip(tests, labels):
        chosen = chosen.when(test, label)
    return chosen.otherwise(labels[-1])


def region_alias(star: Star) -> DataFrame:
    return star.dim_regions.select(F.col("region_id").alias("id"), F.col("region_name").alias("name"))


def region_equals(star: Star, *, region_name: str = "America") -> DataFrame:
    return star.dim_regions.filter(F.col("region_name") == region_name)


def customers_created_between(
    star: Star, *, start: date = date(2023, 9, 9), end: date = date(2026, 1, 31)
) -> DataFrame:
    """Both ends included; ``end`` means midnight at the start of that day."""
    first, last = (F.lit(day).cast("timestamp_ntz") for day in (start, end))
    return star.dim_customers.filter(F.col("created_at").between(first, last))


def dates_in_years(star: Star, *, years: tuple[int, ...] = (2022, 2023, 2024)) -> DataFrame:
    return star.dim_date.filter(F.col("year_num").isin(*years))


def reps_name_prefix(star: Star, *, prefix: str = "A") -> DataFrame:
    """First name starts with ``prefix`` in either case."""
    return star.dim_sales_reps.filter(F.lower("first_name").startswith(prefix.lower()))


def customers_missing_postal(star: Star) -> DataFrame:
    return star.dim_customers.filter(F.col("postal_code").isNull())


def reps_sorted(star: Star) -> DataFrame:
    reps = star.dim_sales_reps.orderBy("first_name", F.desc("last_name"), "sales_rep_id")
    return reps.select("first_name", "last_name", "status")


def customers_top10(star: Star, *, n: int = 10) -> DataFrame:
    """``n`` customers; the lowest ids, to be repeatable."""
    return star.dim_customers.orderBy("customer_id").limit(n)


def product_price_rank(star: Star) -> DataFrame:
    active = star.dim_products.filter("is_active").select(
        "product_id", "product_name", "category_id", "list_price", "unit_cost"
    )
    return rank_descending(active, ["category_id"], "list_price", "price_rank_in_category")


def product_margin_band(star: Star, *, high: int = 60, medium: int = 30) -> DataFrame:
    """Bands use the unrounded margin; a product without a price has no margin and is 'Low'."""
    profit = F.col("list_price") - F.col("unit_cost")
    margin = percent(profit, F.col("list_price"))
    return (
        star.dim_products.filter("is_active")
        .select(
            "product_id",
            "product_name",
            "category_id",
            "unit_cost",
            "list_price",
            profit.alias("gross_profit"),
            F.round(margin, 2).alias("gross_margin_pct"),
            _banded([margin >= high, margin >= medium], MARGIN_BANDS).alias("margin_category"),
        )
        .orderBy(F.desc("gross_margin_pct"), "product_id")
    )


def discount_impact(star: Star, *, high: float = 0.2, medium: float = 0.1) -> DataFrame:
    given, revenue = F.col("total_discount"), F.col("total_revenue")
    share = percent(given, revenue)
    return (
        star.fact_order_line_items.groupBy("product_id")
        .agg(F.sum("discount_amount").alias("total_discount"), F.sum("line_total").alias("total_revenue"))
        .select(
            "product_id",
            "total_discount",
            "total_revenue",
            rounded_percent(given, revenue).alias("discount_impact_pct"),
            _banded(
                [share > _percent_limit(high), share > _percent_limit(medium)], DISCOUNT_LEVELS
            ).alias("discount_level"),
        )
        .orderBy(F.desc("total_revenue"), "product_id")
    )


def _percent_limit(share: float) -> Column:
    return F.lit(Decimal(str(share)) * 100)


def product_sales_summary(star: Star) -> DataFrame:
    return (
        star.fact_order_line_items.groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("total_items_sold"),
            F.sum("quantity").alias("total_quantity"),
            F.sum("line_total").alias("total_revenue"),
        )
        .orderBy(F.desc("total_revenue"), "product_id")
    )


def _blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(column) == "")


def customer_validation(star: Star, *, min_credit: int | None = 45000) -> DataFrame:
    """First rule each customer breaks. ``min_credit=None`` validates every customer; with a
    minimum, the two credit-limit rules cannot fire."""
    customers = star.dim_customers
    limit = F.col("credit_limit")
    if min_credit is not None:
        customers = customers.filter(limit > min_credit)
    faults = [
        _blank("customer_code"),
        _blank("customer_name"),
        _blank("country_name"),
        limit.isNull(),
        limit < 0,
    ]
    return customers.select(
        "customer_id",
        "customer_name",
        "customer_code",
        "billing_address",
        "city",
        "country_name",
        "credit_limit",
        "account_tier",
        _banded(faults, [*CUSTOMER_FAULTS, FAULTLESS]).alias("validation_status"),
    ).orderBy(F.desc("credit_limit"), "customer_name", "customer_id")


def order_validation(star: Star, *, min_total: int | None = 1000) -> DataFrame:
    """First rule each order breaks. ``min_total=None`` validates every order; with a minimum, the
    two total rules cannot fire."""
    orders = star.fact_sales_orders
    total = F.col("net_total")
    if min_total is not None:
        orders = orders.filter(total > min_total)
    faults = [
        F.col("customer_id").isNull(),
        F.col("sales_rep_id").isNull(),
        F.col("order_date_id").isNull(),
        total.isNull(),
        total <= 0,
    ]
    return orders.select(
        "order_id",
        "order_number",
        "customer_id",
        "sales_rep_id",
        "order_status",
        "net_total",
        "order_date_id",
        _banded(faults, [*ORDER_FAULTS, FAULTLESS]).alias("validation_status"),
    ).orderBy(F.desc("net_total"), "order_id")


def gold_high_credit(
    star: Star, *, tier: str = "Gold", country: str = "Germany", min_credit: int = 50000
) -> DataFrame:
    return (
        star.dim_customers.filter(
            (F.col("account_tier") == tier)
            & (F.col("country_name") == country)
            & (F.col("credit_limit") > min_credit)
        )
        .select(
            "customer_id",
            "customer_name",
            "customer_code",
            "city",
            "country_name",
            "credit_limit",
            "account_tier",
        )
        .orderBy(F.desc("credit_limit"), "customer_name", "customer_id")
    )


def high_markup_products(star: Star, *, multiple: int = 3) -> DataFrame:
    price, cost = F.col("list_price"), F.col("unit_cost")
    margin = percent(price - cost, price).cast("decimal(10,2)")
    return (
        star.dim_products.filter(price > cost * multiple)
        .select(
            "product_id",
            "sku",
            "product_name",
            "unit_cost",
            "list_price",
            margin.alias("margin_pct_on_price"),
        )
        .orderBy(F.desc("margin_pct_on_price"), "product_name", "product_id")
    )


def gross_rev_month_region_country(star: Star) -> DataFrame:
    """Revenue before discounts by month and the country of the order's sales region."""
    gross = per_order(star, gross_revenue=F.col("quantity") * F.col("unit_price"))
    return (
        star.fact_sales_orders.select("order_id", "order_date_id", "region_id")
        .join(gross, "order_id")
        .join(star.calendar("order_date_id", "year_num", "month_num"), "order_date_id")
        .join(star.dim_regions.select("region_id", "country_name"), "region_id")
        .groupBy("year_num", "month_num", "country_name")
        .agg(F.sum("gross_revenue").cast("decimal(28,2)").alias("gross_revenue"))
        .orderBy("year_num", "month_num", "country_name")
    )


def aov_region_month(star: Star) -> DataFrame:
    """Average order value: amounts of all rows over distinct orders."""
    return (
        star.fact_sales_orders.select("order_id", "order_date_id", "region_id", "net_total")
        .join(star.calendar("order_date_id", "year_num", "month_num"), "order_date_id")
        .join(star.dim_regions.select("region_id", "region_name"), "region_id")
        .groupBy("year_num", "month_num", "region_name")
        .agg(F.sum("net_total").alias("net"), F.count_distinct("order_id").alias("order_count"))
        .select(
            "year_num",
            "month_num",
            "region_name",
            quotient(F.col("net"), F.col("order_count"), "decimal(12,2)").alias("avg_order_value"),
            "order_count",
        )
        .orderBy("year_num", "month_num", "region_name")
    )
