"""The star as a folder of Parquet tables."""

from pyspark.sql import DataFrame, SparkSession

from tradewind.schema import struct_of
from tradewind.star import Star

# Order queries filter by date, so one folder per order date lets Spark skip the other days
# when it joins the filtered calendar. Quotas are looked up by period in the same way.
PARTITIONED_BY = {"fact_sales_orders": "order_date_id", "fact_quotas": "date_id"}


def read_star(spark: SparkSession, folder: str) -> Star:
    return Star(
        **{name: spark.read.schema(struct_of(name)).parquet(f"{folder}/{name}") for name in Star.names()}
    )


def write_star(star: Star, folder: str) -> None:
    for name in Star.names():
        write_table(getattr(star, name), name, folder)


def write_table(df: DataFrame, name: str, folder: str) -> None:
    key = PARTITIONED_BY.get(name)
    if key is None:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return
    # rebalance brings the rows of one date together without making one task write a busy date.
    rows = df.hint("rebalance", key)
    rows.write.mode("overwrite").partitionBy(key).parquet(f"{folder}/{name}")
