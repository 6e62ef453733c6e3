"""Connected components of a graph of links, in Spark.

Labels start at the smallest neighbour. Each round lowers the label of every node, and that of the node
it points to, to the smallest label among its neighbours, and then lets every node take the label of
its label; both together shorten chains geometrically. Labels are written after each step, so that the
joins meet plain tables, in which adaptive execution can split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each node in ``links`` (columns a, b) the smallest node it can reach."""
    forward = links.select("a", "b")
    edges = written(forward.union(forward.select("b", "a")).where("a != b").distinct())
    labels = written(
        edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    )
    while True:
        old = labels.select("node", F.col("label").alias("old"))
        near = edges.join(labels, edges["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        nearest = written(near.union(labels).groupBy("node").agg(F.min("label").alias("label")))
        parents = old.join(nearest, "node").select(F.col("old").alias("node"), "label")
        hooked = written(nearest.union(parents).groupBy("node").agg(F.min("label").alias("label")))
        above = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = written(hooked.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        if labels.join(old, "node").where("label != old").isEmpty():
            return labels
