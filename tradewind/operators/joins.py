"""Multi-table records, missing matches and revenue roll-ups."""

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.ratios import quotient
from tradewind.functions.slices import whole
from tradewind.operators.facts import named, per_order, sums
from tradewind.star import Star


def full_order_summary(star: Star) -> DataFrame:
    """One row per order line. Orders and lines meet last, each already joined to its dimensions:
    the order side is a fraction of the lines, so its joins move far fewer rows."""
    orders = (
        star.fact_sales_orders.select("order_id", "customer_id", "region_id", "sales_rep_id")
        .join(star.dim_regions.select("region_id", "region_name"), "region_id")
        .join(star.dim_customers.select("customer_id", "customer_name", "country_name"), "customer_id")
        .join(star.dim_sales_reps.select("sales_rep_id", "first_name", "last_name"), "sales_rep_id")
    )
    lines = star.fact_order_line_items.join(
        star.dim_products.select("product_id", "product_name"), "product_id"
    )
    return lines.join(orders, "order_id").select(
        "order_id",
        "customer_name",
        "country_name",
        "region_name",
        "first_name",
        "last_name",
        "product_name",
        "quantity",
        "unit_price",
        "discount_amount",
        "line_total",
    )


def dormant_customers(star: Star) -> DataFrame:
    buyers = star.fact_sales_orders.select("customer_id").distinct()
    return star.dim_customers.select("customer_id", "customer_name").join(
        buyers, "customer_id", "left_anti"
    )


def rep_customer_mismatch(star: Star) -> DataFrame:
    """Orders whose rep is not the one assigned to the customer on the order date.

    Of the assignments valid that day the latest to start counts; among those starting together,
    the one that lasts longest, then the highest id. Orders without a valid assignment drop out.

    Validity depends on the day alone, so it is decided per customer and day. Assignments, at most one per
    customer and start day, are cut into spans that do not overlap; then each day looks up the last cut before
    it. The rows formed for a customer are its days and two for each assignment, both bounded by the calendar,
    however many orders it has; the orders themselves meet just one row each.
    """
    open_end = F.lit(date(9999, 12, 31))
    starts = star.calendar("start_date_id", F.col("full_date").alias("starts"))
    ends = star.calendar("end_date_id", F.col("full_date").alias("ends"))
    lasting = F.struct(F.coalesce("ends", open_end).alias("ends"), "assignment_id")
    spans = (
        star.rep_customer_assignments.join(starts, "start_date_id")
        .join(ends, "end_date_id", "left")
        .groupBy("customer_id", "starts")
        .agg(
            F.max_by("sales_rep_id", lasting).alias("rep"),
            F.max(F.coalesce("ends", open_end)).alias("ends"),
        )
        .filter(F.col("ends") >= F.col("starts"))
        .groupBy("customer_id")
        .agg(F.array_sort(F.collect_list(F.struct("starts", "ends", "rep"))).alias("spans"))
        .select("customer_id", F.inline(_cuts("spans")))
    )
    days = (
        star.fact_sales_orders.select("customer_id", "order_date_id")
        .distinct()
        .join(star.calendar("order_date_id", F.col("full_date").alias("day")), "order_date_id")
    )
    so_far = Window.partitionBy("customer_id").orderBy("day", "turn")
    cut = F.when(F.col("turn") < 2, F.struct("rep"))
    looked_up = (
        spans.withColumn("order_date_id", F.lit(None).cast("int"))
        .unionByName(days.withColumns({"turn": F.lit(2), "rep": F.lit(None).cast("bigint")}))
        .withColumn("cut", F.last(cut, ignorenulls=True).over(so_far))
        .filter("turn = 2")
    )
    assigned = looked_up.select("customer_id", "order_date_id", F.col("cut.rep").alias("assigned_rep"))
    return (
        star.fact_sales_orders.select(
            "order_id", "customer_id", "order_date_id", F.col("sales_rep_id").alias("order_rep")
        )
        .join(assigned.dropna(), ["customer_id", "order_date_id"])
        .filter(F.col("order_rep") != F.col("assigned_rep"))
        .join(star.dim_customers.select("customer_id", "customer_name"), "customer_id")
        .select("order_id", "customer_name", "order_rep", "assigned_rep")
    )


def _cuts(spans: str) -> Column:
    """Where the span that counts changes: (day, turn, rep), given spans in order of their starts.

    The latest to start counts while it lasts; the day after its end the rep of the one that it hid comes back,
    or none. ``open`` holds the spans that can still count, each ending before those under it: a new span drops
    those that do not outlast it, for it hides them to their end. On a day with both, the start (turn 1)
    comes after the return (turn 0).
    """
    cut = "struct<day: date, turn: int, rep: bigint>"
    entry = "struct<ends: date, rep: bigint, under: bigint>"

    def returns(ended: Column) -> Column:
        return F.transform(
            ended, lambda o: F.struct(F.date_add(o["ends"], 1).alias("day"), F.lit(0).alias("turn"), o["under"].alias("rep"))
        )

    def add(state: Column, new: Column) -> Column:
        left = F.filter(state["open"], lambda o: o["ends"] > new["ends"])
        under = F.get(F.transform(left, lambda o: o["rep"]), F.size(left) - 1)
        start = F.struct(new["starts"].alias("day"), F.lit(1).alias("turn"), new["rep"].alias("rep"))
        ended = F.filter(state["open"], lambda o: o["ends"] < new["starts"])
        return F.struct(
            F.concat(left, F.array(F.struct(new["ends"].alias("ends"), new["rep"].alias("rep"), under.alias("under")))).alias("open"),
            F.concat(state["cuts"], returns(ended), F.array(start)).alias("cuts"),
        )

    nothing = F.struct(F.array().cast(f"array<{entry}>").alias("open"), F.array().cast(f"array<{cut}>").alias("cuts"))
    return F.aggregate(spans, nothing, add, lambda state: F.concat(state["cuts"], returns(state["open"])))


def _revenue_by_customer_and_region(star: Star) -> DataFrame:
    revenue = per_order(star, revenue=F.col("line_total"))
    orders = star.fact_sales_orders.select("order_id", "customer_id", "region_id")
    return sums(
        orders.join(revenue, "order_id"), ["customer_id", "region_id"], revenue=F.col("revenue")
    )


def geo_revenue_levels(star: Star) -> DataFrame:
    """Customer country > sales region > territory with subtotals and a grand total.

    ``rolled_up`` tells them apart: 0 for a territory, 1 for a region's subtotal, 3 for a country's, 7 for the
    grand total. A name that is NULL at level 0 is the member without a name, not a subtotal.
    """
    levels = ["country_name", "region_name", "territory_name"]
    places = (
        _revenue_by_customer_and_region(star)
        .join(star.dim_regions.select("region_id", "region_name", "territory_name"), "region_id")
        .join(star.dim_customers.select("customer_id", "country_name"), "customer_id")
    )
    # The roll-up repeats its input once per level, so it runs over the finest totals only.
    finest = sums(places, levels, revenue=F.col("revenue"))
    return (
        finest.rollup(*levels)
        .agg(F.sum("revenue").alias("total_revenue"), F.grouping_id().alias("rolled_up"))
        .orderBy(*levels, "rolled_up")
    )


def geo_revenue_rollup(star: Star) -> DataFrame:
    """``geo_revenue_levels`` with words for what is NULL, as the question asks: members without a name
    read like subtotals."""
    return geo_revenue_levels(star).select(
        F.coalesce("country_name", F.lit("ALL COUNTRIES")).alias("country_name"),
        F.coalesce("region_name", F.lit("ALL REGIONS")).alias("region_name"),
        F.coalesce("territory_name", F.lit("ALL TERRITORIES")).alias("territory_name"),
        "total_revenue",
    )


def line_realised_profit(star: Star) -> DataFrame:
    products = star.dim_products.select("product_id", "product_name", "unit_cost")
    return star.fact_order_line_items.join(products, "product_id").select(
        "product_name",
        "quantity",
        "unit_price",
        "discount_amount",
        F.col("line_total").alias("actual_price"),
        "unit_cost",
        (F.col("line_total") - F.col("quantity") * F.col("unit_cost")).alias("profit"),
    )


def active_products_unordered_12m(star: Star, *, as_of: date, months: int = 12) -> DataFrame:
    recent = F.col("full_date") >= F.add_months(F.lit(as_of), -months)
    orders = (
        star.fact_sales_orders.select("order_id", "order_date_id")
        .join(star.calendar("order_date_id", where=recent), "order_date_id", "left_semi")
        .select("order_id")
    )
    ordered = (
        star.fact_order_line_items.select("order_id", "product_id")
        .join(orders, "order_id", "left_semi")
        .select("product_id")
        .distinct()
    )
    active = star.dim_products.filter("is_active").select("product_id", "product_name")
    return active.join(ordered, "product_id", "left_anti")


def revenue_customer_region_country(star: Star) -> DataFrame:
    """Revenue by customer name and region country; customers of one name add up."""
    return (
        _revenue_by_customer_and_region(star)
        .join(star.dim_regions.select("region_id", "country_name"), "region_id")
        .join(star.dim_customers.select("customer_id", "customer_name"), "customer_id")
        .groupBy("customer_name", "country_name")
        .agg(F.sum("revenue").alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "customer_name", "country_name")
    )


def unit_price_vs_cost(star: Star, *, ordered: bool = True) -> DataFrame:
    """Price, cost and margin of every line; ``ordered=False`` spares the sort of all lines."""
    products = star.dim_products.select(
        "product_id", "product_name", "sku", "category_id", "unit_cost"
    ).join(star.dim_categories.select("category_id", "category_name"), "category_id")
    total, units, cost = F.col("line_total"), F.col("quantity"), F.col("unit_cost")
    lines = (
        star.fact_order_line_items.select("line_item_id", "order_id", "product_id", "quantity", "line_total")
        .join(products, "product_id")
        .select(
            "line_item_id",
            "order_id",
            "product_name",
            "sku",
            "category_name",
            "quantity",
            "unit_cost",
            quotient(total, units, "decimal(10,2)").alias("actual_unit_sell_price"),
            quotient(total - units * cost, units, "decimal(10,2)").alias("unit_margin"),
        )
    )
    return lines.orderBy(F.desc("unit_margin"), "product_name", "line_item_id") if ordered else lines


def customer_order_performance(star: Star) -> DataFrame:
    """Orders, units and revenue by customer, region name and rep name."""
    lines = per_order(star, units=F.col("quantity"), revenue=F.col("line_total"))
    ids = ["customer_id", "region_id", "sales_rep_id"]
    # Orders are dealt by their id already, so that it costs no shuffle to see which ids are on several rows.
    times = F.count(F.lit(1)).over(Window.partitionBy("order_id"))
    rows = whole(
        star.fact_sales_orders.select("order_id", *ids).join(lines, "order_id").withColumn("times", times)
    )
    per_ids = rows.groupBy(*ids).agg(
        F.count(F.when(F.col("times") == 1, F.col("order_id"))).alias("orders"),
        F.sum("units").alias("units"),
        F.sum("revenue").alias("revenue"),
    )
    # Those few count once for each customer, region name and rep name.
    region_ids, _ = named(star.dim_regions, "region_id", ["region_name"], "region")
    rep_ids, _ = named(star.dim_sales_reps, "sales_rep_id", ["first_name", "last_name"], "rep")
    repeated = (
        rows.where(F.col("times") > 1)
        .join(region_ids, "region_id")
        .join(rep_ids, "sales_rep_id")
        .select("customer_id", F.col("region").alias("region_id"), F.col("rep").alias("sales_rep_id"), "order_id")
        .distinct()
        .select(*ids, F.lit(1).cast("bigint").alias("orders"))
    )
    per_group = per_ids.unionByName(repeated, allowMissingColumns=True)
    names = ["customer_id", "customer_name", "country_name", "region_name", "first_name", "last_name"]
    return (
        per_group.join(star.dim_regions.select("region_id", "region_name"), "region_id")
        .join(star.dim_sales_reps.select("sales_rep_id", "first_name", "last_name"), "sales_rep_id")
        .join(star.dim_customers.select("customer_id", "customer_name", "country_name"), "customer_id")
        .groupBy(*names)
        .agg(
            F.sum("orders").alias("total_orders"),
            F.sum("units").alias("total_quantity_purchased"),
            F.sum("revenue").alias("total_revenue"),
        )
        .orderBy(F.desc("total_revenue"), *names)
    )


def returns_by_product_region(star: Star) -> DataFrame:
    """Returns by product and region name, valued at the line's average unit price (six decimals)."""
    lines = star.fact_order_line_items.select(
        "line_item_id", "order_id", "product_id", "quantity", "line_total"
    )
    # A line with many returns meets them as one row. The unit value has 24 digits and the units 13,
    # so that their product keeps all fourteen decimals.
    per_line = star.fact_returns.groupBy("line_item_id").agg(
        F.count("return_id").alias("returns"),
        F.sum("return_quantity").cast("decimal(13,0)").alias("units"),
    )
    unit_value = quotient(F.col("line_total"), F.col("quantity"), "decimal(24,14)")
    per_ids = (
        per_line.join(lines, "line_item_id")
        .join(star.fact_sales_orders.select("order_id", "region_id"), "order_id")
        .groupBy("product_id", "region_id")
        .agg(
            F.sum("returns").alias("returns"),
            F.sum("units").alias("units"),
            F.sum(unit_value * F.col("units")).alias("value"),
        )
    )
    return (
        per_ids.join(star.dim_regions.select("region_id", "region_name"), "region_id")
        .groupBy("product_id", "region_name")
        .agg(
            F.sum("returns").alias("total_returns"),
            F.sum("units").cast("bigint").alias("total_returned_quantity"),
            F.sum("value").cast("decimal(28,6)").alias("estimated_return_value"),
        )
        .join(star.dim_products.select("product_id", "product_name"), "product_id")
        .select(
            "product_id",
            "product_name",
            "region_name",
            "total_returns",
            "total_returned_quantity",
            "estimated_return_value",
        )
        .orderBy(F.desc("estimated_return_value"), "product_id", "region_name")
    )
