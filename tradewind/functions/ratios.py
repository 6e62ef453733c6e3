"""Divisions. A zero divisor gives NULL everywhere, never an error."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wide enough for a hundred-terabyte total, narrow enough that Spark keeps 14 or more
# digits after the point in a quotient, so the final rounding sees the exact half.
_OPERAND = "decimal(20,2)"


def quotient(numerator: Column, denominator: Column, type_: str) -> Column:
    """Decimal quotient, rounded half away from zero to the scale of ``type_``."""
    return _divide(numerator.cast(_OPERAND), denominator).cast(type_)


def percent(numerator: Column, denominator: Column) -> Column:
    """``numerator`` as an unrounded decimal percentage of ``denominator``."""
    return _divide(numerator.cast(_OPERAND) * 100, denominator)


def rounded_percent(numerator: Column, denominator: Column) -> Column:
    return F.round(percent(numerator, denominator), 2)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Unrounded ratio as DOUBLE."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def percent_ratio(numerator: Column, denominator: Column) -> Column:
    """Unrounded percentage as DOUBLE."""
    return ratio(numerator.cast("double") * 100.0, denominator)


def _divide(numerator: Column, denominator: Column) -> Column:
    return numerator / F.nullif(denominator.cast(_OPERAND), F.lit(0).cast(_OPERAND))
