"""Connected components by labels that spread along links and jump along chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for every node of links (a, b). Nothing but a flag reaches the driver.

    A round sends only the labels that changed in the round before, and looks up each label once, however many nodes bear it:
    what a large component's members are joined with is a table of the labels that have a smaller one themselves.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = durable(both.where("a <> b").distinct(), "links")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    changed = labels
    while True:
        near = both.join(changed, both.a == changed.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node", "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        spread = durable(spread, "spread")
        lower = spread.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumps = spread.select("label").distinct().join(lower, "label")
        jumped = spread.join(jumps, "label", "left").select("node", F.least("label", "next").alias("label"), "old")
        jumped = durable(jumped, "labels")
        labels, changed = jumped.select("node", "label"), jumped.where("label < old").select("node", "label")
        if changed.isEmpty():
            return labels
