"""Foreign keys and the uniqueness of what they refer to, checked by a job since Spark enforces neither."""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.star import Star


class ForeignKey(NamedTuple):
    name: str
    child: str
    column: str
    parent: str
    key: str


# Fixed values
FOREIGN_KEYS = [
    ForeignKey("fk_customer_region", "dim_customers", "region_id", "dim_regions", "region_id"),
    ForeignKey("fk_product_category", "dim_products", "category_id", "dim_categories", "category_id"),
    ForeignKey("fk_salesrep_region", "dim_sales_reps", "region_id", "dim_regions", "region_id"),
    ForeignKey("fk_line_order", "fact_order_line_items", "order_id", "fact_sales_orders", "order_id"),
    ForeignKey("fk_line_product", "fact_order_line_items", "product_id", "dim_products", "product_id"),
    ForeignKey("fk_quota_date", "fact_quotas", "date_id", "dim_date", "date_id"),
    ForeignKey("fk_quota_region", "fact_quotas", "region_id", "dim_regions", "region_id"),
    ForeignKey("fk_quota_salesrep", "fact_quotas", "sales_rep_id", "dim_sales_reps", "sales_rep_id"),
    ForeignKey("fk_return_date", "fact_returns", "return_date_id", "dim_date", "date_id"),
    ForeignKey("fk_return_line", "fact_returns", "line_item_id", "fact_order_line_items", "line_item_id"),
    ForeignKey("fk_order_customer", "fact_sales_orders", "customer_id", "dim_customers", "customer_id"),
    ForeignKey("fk_order_orderdate", "fact_sales_orders", "order_date_id", "dim_date", "date_id"),
    ForeignKey("fk_order_region", "fact_sales_orders", "region_id", "dim_regions", "region_id"),
    ForeignKey("fk_order_salesrep", "fact_sales_orders", "sales_rep_id", "dim_sales_reps", "sales_rep_id"),
    ForeignKey("fk_order_shipdate", "fact_sales_orders", "shipping_date_id", "dim_date", "date_id"),
    ForeignKey("fk_promo_enddate", "product_promotions", "end_date_id", "dim_date", "date_id"),
    ForeignKey("fk_promo_product", "product_promotions", "product_id", "dim_products", "product_id"),
    ForeignKey("fk_promo_startdate", "product_promotions", "start_date_id", "dim_date", "date_id"),
    ForeignKey("fk_assignment_customer", "rep_customer_assignments", "customer_id", "dim_customers", "customer_id"),
    ForeignKey("fk_assignment_enddate", "rep_customer_assignments", "end_date_id", "dim_date", "date_id"),
    ForeignKey("fk_assignment_salesrep", "rep_customer_assignments", "sales_rep_id", "dim_sales_reps", "sales_rep_id"),
    ForeignKey("fk_assignment_startdate", "rep_customer_assignments", "start_date_id", "dim_date", "date_id"),
]



def referential_integrity_report(star: Star) -> DataFrame:
    """Per foreign key, the rows with a key and those whose key has no parent; per referenced key, the rows
    with one and those that repeat it.

    NULL keys are neither checked nor a violation. A parent that is there several times counts once for its
    children. A table is read once for all its foreign keys: its rows unfold to one for each constraint, which
    fold again to one per constraint and key before they move.

    Whole numbers are compared as such; a key is text only if it or what it refers to is. The whole-number
    keys of a parent are a set of bits, one row for each 64 neighbours that occur: dense keys take a 64th of
    their rows, sparse ones never more than a row each.
    """
    constraints = [(fk, _whole(star, (fk.child, fk.column), (fk.parent, fk.key))) for fk in FOREIGN_KEYS]
    sets = [*dict.fromkeys((fk.parent, fk.key, whole) for fk, whole in constraints)]
    children = [
        _keys(star, child, [(k, fk.column, whole) for k, (fk, whole) in enumerate(constraints) if fk.child == child])
        for child in dict.fromkeys(fk.child for fk in FOREIGN_KEYS)
    ]
    parents = [_keys(star, table, [(len(constraints) + k, key, whole)]) for k, (table, key, whole) in enumerate(sets)]
    rows = F.count(F.lit(1)).alias("rows")
    per_key = reduce(DataFrame.unionByName, children).groupBy("checked", "number", "name").agg(rows)
    per_word = (
        reduce(DataFrame.unionByName, parents)
        .groupBy("checked", _word(), "name")
        .agg(rows, F.bit_or(F.expr("shiftleft(1L, CAST(number & 63 AS INT))")).alias("present"))
    )
    set_of = F.array(*[F.lit(len(constraints) + sets.index((fk.parent, fk.key, whole))) for fk, whole in constraints])
    found = per_word.select(F.col("checked").alias("set"), "word", "name", "present")
    there = F.getbit("present", F.col("number").bitwiseAND(F.lit(63)).cast("int")) == 1
    checked = (
        per_key.select("*", F.get(set_of, "checked").alias("set"), _word())
        .join(found, ["set", "word", "name"], "left")
        .select("checked", "rows", F.when(there, 0).otherwise(F.col("rows")).alias("faults"))
        .unionByName(per_word.select("checked", "rows", (F.col("rows") - F.bit_count("present")).alias("faults")))
        .groupBy("checked")
        .agg(F.sum("rows").alias("checked_rows"), F.sum("faults").alias("violations"))
    )
    listed = [(k, fk.name, fk.child, fk.column, fk.parent) for k, fk in enumerate(FOREIGN_KEYS)]
    for table, key in dict.fromkeys((fk.parent, fk.key) for fk in FOREIGN_KEYS):
        first = next(k for k, own in enumerate(sets) if own[:2] == (table, key))
        listed.append((len(constraints) + first, f"uq_{table}_{key}", table, key, table))
    names = ["checked", "constraint_name", "child_table", "child_column", "parent_table"]
    wanted = star.dim_date.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in listed]))
    )
    none = F.lit(0)
    return wanted.join(checked, "checked", "left").select(
        "constraint_name",
        "child_table",
        "child_column",
        "parent_table",
        F.coalesce("checked_rows", none).alias("checked_rows"),
        F.coalesce("violations", none).alias("violations"),
    )


def _word() -> Column:
    """Which run of 64 neighbouring numbers a key is in."""
    return F.shiftright("number", 6).alias("word")


def _whole(star: Star, *keys: tuple[str, str]) -> bool:
    return all(isinstance(getattr(star, table).schema[column].dataType, T.IntegralType) for table, column in keys)


def _keys(star: Star, table: str, columns: list[tuple[int, str, bool]]) -> DataFrame:
    """(checked, number, name): the keys of each row under the number they are checked by, with 0 as the number of
    a text and '' as the name of a whole number."""
    keys = [
        F.struct(
            F.lit(checked).alias("checked"),
            (F.col(c) if whole else F.when(F.col(c).isNotNull(), 0)).cast("bigint").alias("number"),
            F.lit("").alias("name") if whole else F.col(c).cast("string").alias("name"),
        )
        for checked, c, whole in columns
    ]
    return getattr(star, table).select(F.inline(F.array(*keys))).dropna(subset="number")
