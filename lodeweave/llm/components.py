"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import stored


def components(links: DataFrame) -> DataFrame:
    """links has (a, b); returns (node, label), label the smallest node reachable.

    Each round takes the least label among a node's neighbours and then that label's own label, so chains
    halve; both steps pre-aggregate per node. It ends when no label changes.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = stored(step.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels
