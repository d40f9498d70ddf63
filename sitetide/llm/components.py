"""Connected components of links that may be as many as the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitetide.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected links (a, b): the smallest node that is reachable.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so long chains halve.
    Labels are combined before they are shuffled; each round's labels are staged.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).filter("node <> other")
    edges = staged(both.union(both.select("other", "node")).distinct())
    labels = staged(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").select("node", "component")
        lowest = near.union(labels).groupBy("node").agg(F.min("component").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        old = labels.withColumnRenamed("component", "old")
        new = staged(lowest.join(jump, "low", "left").join(old, "node").select(
            "node", F.coalesce("lower", "low").alias("component"), "old"))
        labels = new.select("node", "component")
        if new.filter("component <> old").isEmpty():
            return labels
