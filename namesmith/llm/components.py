"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node in ``links`` (``a, b``): the least node it can reach.

    Each round takes the least label among a node and its neighbours and then follows that
    label once, so distances shrink by half or better; each round is written, which cuts
    lineage. Hubs are aggregated before the shuffle, and joins on them are inner joins
    that Spark can split.
    """
    both = stage(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links"
    )
    labels = stage(
        both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
        .withColumnRenamed("a", "node"), "labels",
    )
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(
            F.min("label").alias("_near"))
        nearer = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("_label"))
        jumps = labels.select(F.col("node").alias("_label"), F.col("label").alias("_far"))
        new = stage(
            nearer.join(jumps, "_label").select(
                "node", F.least("_label", "_far").alias("label"), "_old"), "labels",
        )
        changed = new.where("label <> _old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
