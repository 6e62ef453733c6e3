"""Running totals and ranks over groups of any size, as one lazy plan.

A plain window sorts each group inside one task, which fails once a group holds a large share of all
rows. Here each group is cut into slices by an expression that never falls along the order, so slices
follow each other and their numbers depend on nothing but the row. A small aggregate, one row for each
slice and group, gives what came before a slice; that number joins the slice as a first row, a mark, and
the window then runs inside the slice alone. Rows are shuffled once, nothing is written, and no job runs
before the result is asked for, so a view over it follows its tables.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_VALUE = "_value"
_MARK = "_mark"
_COUNT = "_count"
STEPS_PER_OCTAVE = 64


def magnitude(value: str | Column) -> Column:
    """A whole number that never falls as ``value`` grows, in steps of about one percent of it.

    It needs no bounds of the data; NULL stays NULL. Values that lie within one percent share a slice.
    """
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    steps = F.floor(F.log2(F.abs(number) + 1) * STEPS_PER_OCTAVE)
    return F.when(number < 0, -steps).otherwise(steps)


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    value: str,
    name: str,
    slices: Sequence[Column],
    *,
    descending: bool = False,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` from the group's first row to the current one.

    ``order`` ends in a key, for a repeatable result. ``slices`` never fall along the order, or never rise
    if ``descending``; NULL comes last.
    """
    keys = [f"_slice_{k}" for k in range(len(slices))]
    sliced = df.withColumns(dict(zip(keys, slices, strict=True)))
    along = [F.desc_nulls_last(k) if descending else F.asc_nulls_last(k) for k in keys]
    earlier = Window.partitionBy(*group).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    marks = (
        sliced.groupBy(*group, *keys)
        .agg(F.sum(value).alias("_total"))
        .select(*group, *keys, F.sum("_total").over(earlier).alias(_VALUE), F.lit(True).alias(_MARK))
    )
    rows = sliced.withColumns({_VALUE: F.col(value), _MARK: F.lit(False)})
    so_far = (
        Window.partitionBy(*group, *keys)
        .orderBy(F.desc(_MARK), *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.unionByName(marks, allowMissingColumns=True)
        .withColumn(name, F.sum(_VALUE).over(so_far))
        .filter(~F.col(_MARK))
        .select(*df.columns, name)
    )


def row_number(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str,
    slices: Sequence[Column],
    *,
    descending: bool = False,
) -> DataFrame:
    """Add ``name``: the row's place in its group, from 1."""
    counted = df.withColumn(_COUNT, F.lit(1).cast("bigint"))
    return running_total(counted, group, order, _COUNT, name, slices, descending=descending).drop(_COUNT)


def whole(df: DataFrame) -> DataFrame:
    """``df`` with a filter that drops nothing and reads every column.

    A plan that uses it twice then has the same columns both times, so that Spark shuffles and scans its
    input once, whichever columns either use needs.
    """
    return df.where(F.bit_count(F.xxhash64(*df.columns)) >= 0)


def rank_descending(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``: 1 + the number of rows of the group with a greater ``value``; NULL ranks last.

    Rows fold to one for each group and value first, so ties cost nothing, and each distinct value meets
    its rows again in a join that Spark can split. The rows and their fold share the shuffles of ``df``.
    """
    df = whole(df)
    folded = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias(_COUNT))
    down_to = running_total(
        folded, group, [F.desc_nulls_last(value)], _COUNT, "_down_to", [magnitude(value)], descending=True
    )
    keys = [*group, value]
    ranks = down_to.select(
        *[F.col(key).alias(f"_of_{key}") for key in keys],
        (F.col("_down_to") - F.col(_COUNT) + 1).alias(name),
    )
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    return df.join(ranks, same).select(*df.columns, name)
