"""The star as catalog tables, orders and lines bucketed alike by order.

Nearly every question joins lines to their order. With both sides in the same buckets Spark sums
lines per order and joins them without shuffling either.
"""

from pyspark.sql import DataFrame, SparkSession

from tradewind.schema import struct_of
from tradewind.star import Star

BUCKETED_BY_ORDER = ("fact_sales_orders", "fact_order_line_items")


def save_star(star: Star, database: str, *, buckets: int | None = None) -> None:
    """Write all tables to ``database``, orders and lines in ``buckets`` by order if that is given.

    With about ``total size / 1 GB`` buckets each is a fair task. One task reads a bucket whole, so leave
    ``buckets`` out if a single order may fill one: Spark then shuffles lines and can split such an order.
    """
    spark = star.dim_date.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in Star.names():
        rows = getattr(star, name)
        if buckets and name in BUCKETED_BY_ORDER:
            # One task per bucket before the write keeps it to one file per bucket.
            writer = rows.repartition(buckets, "order_id").write.bucketBy(buckets, "order_id").sortBy("order_id")
        else:
            writer = rows.write
        writer.mode("overwrite").format("parquet").saveAsTable(f"{database}.{name}")


def table_star(spark: SparkSession, database: str) -> Star:
    tables = {}
    for name in Star.names():
        columns = struct_of(name).fieldNames()
        tables[name] = spark.table(f"{database}.{name}").select(columns)
    return Star(**tables)
