"""Facts summed to the grain of the next join.

Summing first keeps a busy order, customer or product from becoming one large shuffle block: the
map side already folds its rows into one, and the join that follows meets each key once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.star import Star


def per_order(star: Star, **measures: Column) -> DataFrame:
    """Line measures summed per order: one row for every order that has lines."""
    return sums(star.fact_order_line_items, ["order_id"], **measures)


def named(dimension: DataFrame, key: str, names: list[str], group: str) -> tuple[DataFrame, DataFrame]:
    """(``key``, ``group``) and (``group``, ``names``): ids of rows alike in ``names`` become one id.

    Distinct counts by name are then taken by id at the grain of orders, before names join.
    """
    groups = dimension.groupBy(*names).agg(F.min(key).alias(group))
    renamed = groups.select(*[F.col(name).alias(f"_{name}") for name in names], group)
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in names]
    ids = dimension.select(key, *names).distinct().join(renamed, same).select(key, group)
    return ids, groups


def sums(df: DataFrame, keys: list[str], **measures: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(measure).alias(name) for name, measure in measures.items()])


def last_full_year(star: Star, as_of) -> Column:
    """The latest calendar year before the one of ``as_of``."""
    years = star.dim_date.filter(F.col("year_num") < as_of.year)
    return years.agg(F.max("year_num")).scalar()


def latest(star: Star, column: str) -> Column:
    return star.dim_date.agg(F.max(column)).scalar()
