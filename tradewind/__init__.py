"""Sales analytics over a retail star schema, written for Spark."""

from tradewind.star import Star

__all__ = ["Star"]
