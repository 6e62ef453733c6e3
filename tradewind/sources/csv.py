"""CSV extracts of the star tables: header line, comma, UTF-8, any record ending."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.schema import struct_of

DATE_FORMAT = "M/d/yyyy"
# The tables that are delivered as extracts.
EXTRACTS = (
    "dim_categories",
    "dim_products",
    "dim_regions",
    "dim_sales_reps",
    "fact_quotas",
    "product_promotions",
    "rep_customer_assignments",
)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table, typed as in ``schema``. Dates are M/d/yyyy; flags are true/false or 1/0."""
    wanted = struct_of(table)
    as_text = T.StructType([T.StructField(field.name, T.StringType()) for field in wanted])
    rows = (
        spark.read.schema(as_text)
        .options(header=True, encoding="UTF-8", enforceSchema=False, mode="FAILFAST")
        .csv(path)
    )
    return rows.select([_typed(field).alias(field.name) for field in wanted])


def read_extracts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table of the star that has an extract, ``<table>.csv`` in ``folder``."""
    return {table: read_table(spark, f"{folder}/{table}.csv", table) for table in EXTRACTS}


def _typed(field: T.StructField):
    text = F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        return F.to_date(text, DATE_FORMAT)
    return text.cast(field.dataType)
