"""The twelve tables that every operator takes."""

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Star:
    dim_categories: DataFrame
    dim_products: DataFrame
    dim_regions: DataFrame
    dim_sales_reps: DataFrame
    dim_customers: DataFrame
    dim_date: DataFrame
    fact_sales_orders: DataFrame
    fact_order_line_items: DataFrame
    fact_returns: DataFrame
    fact_quotas: DataFrame
    product_promotions: DataFrame
    rep_customer_assignments: DataFrame

    @classmethod
    def names(cls) -> list[str]:
        return [field.name for field in fields(cls)]

    # No join with a table carries a broadcast hint: Spark decides by the tables' statistics, in bytes, whenever it plans
    # and again at run time, so a table that has grown is shuffled.

    def calendar(self, key: str, *columns: str | Column, where: Column | None = None) -> DataFrame:
        """Dates in one of their roles: the date key renamed to the fact's column ``key``."""
        dates = self.dim_date if where is None else self.dim_date.filter(where)
        return dates.select(F.col("date_id").alias(key), *columns)

    def in_days(self, days: DataFrame) -> "Star":
        """The star of these days alone: their orders and the lines of these. Other facts stay, and fall out
        where they meet the calendar."""
        orders = self.fact_sales_orders.join(
            days.select(F.col("date_id").alias("order_date_id")), "order_date_id", "left_semi"
        )
        lines = self.fact_order_line_items.join(orders.select("order_id"), "order_id", "left_semi")
        return replace(
            self,
            dim_date=days.select(*self.dim_date.columns),
            fact_sales_orders=orders.select(*self.fact_sales_orders.columns),
            fact_order_line_items=lines.select(*self.fact_order_line_items.columns),
        )

    # The rows that the inner joins of a base view keep: those whose keys all have a parent. Spark enforces
    # no foreign key, so the summaries look the parents up, but at the grain of orders and without their
    # columns. Duplicate parents, which the wide joins would multiply, are left to operators.integrity.

    @property
    def sold_products(self) -> DataFrame:
        """Products that have a category."""
        return self.dim_products.join(self.dim_categories.select("category_id"), "category_id", "left_semi")

    @property
    def sold_lines(self) -> DataFrame:
        """Lines of sold products. Whether they have an order shows when they meet it."""
        return self.fact_order_line_items.join(self.sold_products.select("product_id"), "product_id", "left_semi")

    @property
    def sold_lines_by_bits(self) -> DataFrame:
        """The same lines, with products looked up as sets of bits, one row for each 64 neighbouring keys that occur.

        By its files' size a table of keys seems small enough to broadcast when in the driver's memory it is many times
        larger, which a plan that is large itself has no room for.
        """
        key = F.col("product_id")
        run, place = F.shiftright(key, 6), key.bitwiseAND(F.lit(63)).cast("int")
        sold = self.sold_products.groupBy(run.alias("_run")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).alias("_sold")
        )
        same = (run == F.col("_run")) & (F.getbit("_sold", place) == 1)
        return self.fact_order_line_items.join(sold, same, "left_semi")

    @property
    def sold_orders(self) -> DataFrame:
        """Orders with customer, rep, region and order date."""
        return self.returnable_orders.join(self.calendar("order_date_id"), "order_date_id", "left_semi")

    @property
    def returnable_orders(self) -> DataFrame:
        """Orders with customer, rep and region."""
        orders = self.fact_sales_orders
        for parent, key in (
            (self.dim_regions, "region_id"),
            (self.dim_sales_reps, "sales_rep_id"),
            (self.dim_customers, "customer_id"),
        ):
            orders = orders.join(parent.select(key), key, "left_semi")
        return orders

    @property
    def assigned_quotas(self) -> DataFrame:
        """Quotas with rep and region."""
        return self.fact_quotas.join(self.dim_sales_reps.select("sales_rep_id"), "sales_rep_id", "left_semi").join(
            self.dim_regions.select("region_id"), "region_id", "left_semi"
        )
