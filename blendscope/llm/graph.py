"""Connected components of a link table, as joins and aggregates over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendscope.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); the label is the smallest node reachable.

    Each round takes the smallest label around a node and then the label of that label, so the number of rounds grows
    with the logarithm of the longest path. A hot node is aggregated before the shuffle, and its joins can be split.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        after = materialize(step.join(jump, "to").select("node", "old", F.least("to", "far").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("old != label").isEmpty():
            return labels
