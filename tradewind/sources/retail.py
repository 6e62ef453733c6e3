"""The star over order-entry tables (region, nation, customer, supplier, part, orders, lineitem).

Every source row is kept. Rows that the anti-join queries look for (customers without orders,
products without lines, reps without accounts) come from booking to a neighbour: some customers
are billed through the customer before them, some parts are sold under the part before them, and
reps whose number ends in 9 pass their accounts to the rep before them.

Facts are plain projections of ``orders`` and ``lineitem``, so a query's own joins are the only
ones in its plan.
"""

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.schema import struct_of
from tradewind.star import Star

AS_OF = date(2001, 8, 1)

# Fixed values
REP_FIRST_NAMES = ["Ann", "Bob", "Ada", "Carl", "Dina"]
RETURN_REASONS = ["DEFECT", "WRONG_ITEM", "DAMAGED", "OTHER"]
RECENT_HANDOVER = date(2001, 3, 1)
EARLY_HANDOVER = date(1998, 1, 1)


def load_star(spark: SparkSession, folder: str) -> Star:
    source = {
        name: spark.read.parquet(f"{folder}/{name}.parquet")
        for name in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    }
    first, last = source["orders"].agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    first, last = first.date(), last.date()
    reps = source["supplier"].count()
    nations = source["nation"].count()
    tables = {
        "dim_categories": _categories(source["part"]),
        "dim_products": _products(source["part"]),
        "dim_regions": _regions(source["nation"], source["region"]),
        "dim_sales_reps": _sales_reps(source["supplier"]),
        "dim_customers": _customers(source["customer"], source["nation"]),
        "dim_date": calendar(source["orders"], "o_orderdate"),
        "fact_sales_orders": _sales_orders(source["orders"], reps, nations, last),
        "fact_order_line_items": _line_items(source["lineitem"]),
        "fact_returns": _returns(source["lineitem"], last),
        "fact_quotas": _quotas(source["supplier"], first, last),
        "product_promotions": _promotions(source["part"]),
        "rep_customer_assignments": _assignments(source["customer"], reps),
    }
    return Star(**{name: _typed(name, df) for name, df in tables.items()})


def calendar(days: DataFrame, column: str) -> DataFrame:
    """Every day from the first to the last in ``column``.

    The days between the two bounds are one scalar subquery, which Spark runs once for all roles that a query gives the
    calendar.
    """
    day = F.col(column).cast("date")
    between = days.agg(F.sequence(F.min(day), F.max(day)).alias("days")).scalar()
    one = days.sparkSession.sql("SELECT 1 AS one")
    return one.select(F.explode(between).alias("full_date")).select(
        date_id("full_date").alias("date_id"),
        "full_date",
        F.year("full_date").alias("year_num"),
        F.quarter("full_date").alias("quarter_num"),
        F.month("full_date").alias("month_num"),
        F.date_format("full_date", "MMMM").alias("month_name"),
    )


def date_id(day: str | Column) -> Column:
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def _typed(table: str, df: DataFrame) -> DataFrame:
    return df.select([F.col(field.name).cast(field.dataType) for field in struct_of(table)])


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _one_of(values: list[str], index: Column) -> Column:
    return F.element_at(F.array([F.lit(value) for value in values]), (index + 1).cast("int"))


def _cents(column: str, type_: str = "decimal(14,2)") -> Column:
    return F.col(column).cast(type_)


def _midnight(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def _category_id() -> Column:
    return F.floor((F.col("p_size") - 1) / 5) + 1


def _categories(part: DataFrame) -> DataFrame:
    key = F.col("category_id")
    return (
        part.select(_category_id().alias("category_id"))
        .distinct()
        .select(
            key,
            _text("SEG_", key % 3).alias("segment_name"),
            # Eight names for ten bands: the name is not a key.
            _text("BAND_", key % 8).alias("category_name"),
            _text("SUB_", key % 5).alias("subcategory_name"),
            (key % 10 + 1).alias("parent_category_id"),
            F.lit(True).alias("is_active"),
            F.lit(date(1994, 1, 1)).alias("created_at"),
        )
    )


def _products(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    price = _cents("p_retailprice", "decimal(12,2)")
    cost_percent = (F.col("p_size") * 2 + 20).cast("decimal(5,0)")
    return part.select(
        key.alias("product_id"),
        (key + 1000).alias("sku"),
        _text(F.col("p_name"), " ", F.col("p_type")).alias("product_name"),
        _category_id().alias("category_id"),
        F.round(price * cost_percent * F.lit("0.01").cast("decimal(3,2)"), 2).alias("unit_cost"),
        price.alias("list_price"),
        (key % 500).alias("stock_quantity"),
        (key % 5 != 0).alias("is_active"),
        F.date_add(F.lit(date(1994, 1, 1)), (key % 365).cast("int")).alias("created_at"),
    )


def _regions(nation: DataFrame, region: DataFrame) -> DataFrame:
    key = F.col("n_nationkey")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        key.alias("region_id"),
        F.col("n_name").alias("country_name"),
        F.col("r_name").alias("region_name"),
        _text(F.col("n_name"), "_T").alias("territory_name"),
        _text("N", key).alias("country_code"),
        (key % 5 != 0).alias("is_active"),
        F.lit(date(1994, 1, 1)).alias("created_at"),
    )


def _sales_reps(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        key.alias("sales_rep_id"),
        key.alias("employee_code"),
        _one_of(REP_FIRST_NAMES, key % 5).alias("first_name"),
        F.col("s_name").alias("last_name"),
        _text(key, "@example.org").alias("email"),
        _text("555-", key).alias("phone"),
        F.date_add(F.lit(date(1990, 1, 1)), (key % 1800).cast("int")).alias("hire_date"),
        (key % 500 + 3000).alias("base_salary"),
        F.when(F.col("s_acctbal") < 0, "Inactive").otherwise("Active").alias("status"),
        F.col("s_nationkey").alias("region_id"),
        F.lit(date(1994, 1, 1)).alias("created_at"),
    )


def _customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    segment = F.col("c_mktsegment")
    created = F.date_add(F.lit(date(2023, 1, 1)), (key % 1200).cast("int"))
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        key.alias("customer_id"),
        _text("C", key).alias("customer_code"),
        F.col("c_name").alias("customer_name"),
        _text("ADDR_", key).alias("billing_address"),
        _text("CITY_", key % 50).alias("city"),
        F.when(key % 10 != 0, key.cast("string")).alias("postal_code"),
        F.col("n_name").alias("country_name"),
        (_cents("c_acctbal", "decimal(12,2)") * 10).alias("credit_limit"),
        F.when(segment == "BUILDING", "Gold")
        .when(segment == "AUTOMOBILE", "Silver")
        .otherwise("Bronze")
        .alias("account_tier"),
        F.col("c_nationkey").alias("region_id"),
        _midnight(created).alias("created_at"),
    )


def _handover(customer: Column) -> Column:
    return F.when(customer % 3 == 0, F.lit(RECENT_HANDOVER)).otherwise(F.lit(EARLY_HANDOVER))


def _account_rep(number: Column, reps: int) -> Column:
    rep = number % reps
    return F.when(rep % 10 == 9, rep - 1).otherwise(rep)


def _billed_customer() -> Column:
    key = F.col("o_custkey")
    return F.when((key > 0) & (key % 97 == 0), key - 1).otherwise(key)


def _sold_part() -> Column:
    key = F.col("l_partkey")
    return F.when((key > 0) & (key % 53 == 0), key - 1).otherwise(key)


def _assignments(customer: DataFrame, reps: int) -> DataFrame:
    key = F.col("c_custkey")
    handover = _handover(key)
    first = F.struct(
        (key * 2).alias("assignment_id"),
        _account_rep(key, reps).alias("sales_rep_id"),
        F.lit(19950101).alias("start_date_id"),
        date_id(F.date_sub(handover, 1)).alias("end_date_id"),
        (key % 4 != 0).alias("is_primary_rep"),
    )
    second = F.struct(
        (key * 2 + 1).alias("assignment_id"),
        _account_rep(key + 1, reps).alias("sales_rep_id"),
        date_id(handover).alias("start_date_id"),
        F.lit(None).cast("int").alias("end_date_id"),
        (key % 25 != 0).alias("is_primary_rep"),
    )
    return customer.select(
        key.alias("customer_id"), F.lit("00:00.0").alias("created_at"), F.inline(F.array(first, second))
    )


def _sales_orders(orders: DataFrame, reps: int, nations: int, last: date) -> DataFrame:
    key = F.col("o_orderkey")
    customer = _billed_customer()
    ordered = F.col("o_orderdate").cast("date")
    shipped = F.least(F.date_add(ordered, (key * 7 % 31).cast("int")), F.lit(last))
    account = F.when(ordered < _handover(customer), customer).otherwise(customer + 1)
    net = _cents("o_totalprice")
    discount = F.round(net * F.lit("0.05").cast("decimal(3,2)"), 2).cast("decimal(14,2)")
    return orders.select(
        key.alias("order_id"),
        _text("SO", key).alias("order_number"),
        customer.alias("customer_id"),
        _account_rep(F.when(key % 10 == 0, customer + 2).otherwise(account), reps).alias("sales_rep_id"),
        date_id(ordered).alias("order_date_id"),
        date_id(shipped).alias("shipping_date_id"),
        (customer % nations).alias("region_id"),
        F.when(F.col("o_orderstatus") == "O", "Pending")
        .when(F.col("o_orderstatus") == "P", "Partially Delivered")
        .otherwise("Delivered")
        .alias("order_status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Prepaid").otherwise("Net 30").alias("payment_terms"),
        F.lit("EUR").alias("currency_code"),
        (net + discount).alias("gross_total"),
        discount.alias("discount_total"),
        net.alias("net_total"),
        F.col("o_orderdate").alias("created_at"),
    )


def _line_key() -> Column:
    cents = (_cents("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws(
        "-",
        *[F.col(name).cast("string") for name in ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]],
        cents.cast("string"),
    )


def _line_total() -> Column:
    kept = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    return F.round(_cents("l_extendedprice") * kept, 2).cast("decimal(14,2)")


def _line_items(lineitem: DataFrame) -> DataFrame:
    price = _cents("l_extendedprice")
    discount = F.col("l_discount").cast("decimal(4,2)")
    quantity = F.col("l_quantity").cast("int")
    return lineitem.select(
        _line_key().alias("line_item_id"),
        F.col("l_orderkey").alias("order_id"),
        _sold_part().alias("product_id"),
        F.col("l_linenumber").alias("line_number"),
        quantity.alias("quantity"),
        F.round(price / quantity, 2).alias("unit_price"),
        discount.alias("discount_pct"),
        F.round(price * discount, 2).alias("discount_amount"),
        _line_total().alias("line_total"),
        F.col("l_shipdate").alias("created_at"),
    )


def _returns(lineitem: DataFrame, last: date) -> DataFrame:
    number = F.col("l_linenumber")
    quantity = F.col("l_quantity").cast("int")
    returned = F.least(quantity, number % 3 + 1)
    day = F.least(F.date_add(F.col("l_shipdate").cast("date"), number * 5), F.lit(last))
    return lineitem.filter(F.col("l_returnflag") == "R").select(
        _text("R", _line_key()).alias("return_id"),
        _line_key().alias("line_item_id"),
        date_id(day).alias("return_date_id"),
        returned.alias("return_quantity"),
        _one_of(RETURN_REASONS, number % 4).alias("return_reason_code"),
        _text("CN", _line_key()).alias("credit_note_number"),
        F.round(_line_total() * returned / quantity, 2).alias("credit_note_value"),
        _midnight(day).alias("created_at"),
    )


def _quotas(supplier: DataFrame, first: date, last: date) -> DataFrame:
    rep = F.col("s_suppkey")
    # The first of every month of the calendar.
    start = first if first.day == 1 else date(first.year + first.month // 12, first.month % 12 + 1, 1)
    months = (last.year - start.year) * 12 + last.month - start.month + 1
    # Each copy of a rep meets the periods in a join and not in an explode: Spark takes the rows of an explode to be as
    # many as before, and would broadcast all quotas.
    periods = supplier.sparkSession.range(2 * max(months, 0)).select(
        (F.col("id") % 2).cast("int").alias("copy"),
        F.add_months(F.lit(start), F.floor(F.col("id") / 2).cast("int")).alias("month_start"),
    )
    month = F.col("month_start")
    quarterly = F.col("quota_period_type") == "Quarterly"
    target = rep * 7919 % 400000 + 50000
    # Some reps have each quota twice, as a real extract may.
    copies = F.when(rep % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    serial = (F.year(month) * 12 + F.month(month)) * 4 + F.when(quarterly, 2).otherwise(0) + F.col("copy")
    return (
        supplier.select(rep, "s_nationkey", F.explode(copies).alias("copy"))
        .join(periods, "copy")
        .withColumn(
            "quota_period_type",
            F.explode(
                F.when(F.month("month_start") % 3 == 1, F.array(F.lit("Monthly"), F.lit("Quarterly")))
                .otherwise(F.array(F.lit("Monthly")))
            ),
        )
        .select(
            (rep * 1_000_000 + serial).alias("quota_id"),
            rep.alias("sales_rep_id"),
            F.col("s_nationkey").alias("region_id"),
            date_id("month_start").alias("date_id"),
            "quota_period_type",
            F.when(quarterly, target * 3).otherwise(target).alias("quota_target"),
            F.lit("00:00.0").alias("created_at"),
        )
    )


def _promotions(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(
        key.alias("promotion_id"),
        key.alias("product_id"),
        F.lit("Summer Sale").alias("promotion_name"),
        ((key % 31).cast("decimal(4,0)") * F.lit("0.01").cast("decimal(3,2)")).alias("discount_pct"),
        (key % 28 + 19990601).alias("start_date_id"),
        (key % 28 + 19990901).alias("end_date_id"),
        (key % 2 == 0).alias("is_active"),
        F.lit("00:00.0").alias("created_at"),
    )
