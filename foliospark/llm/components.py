"""Connected components of a links table by smallest labels and shortcuts, in joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the label is the smallest node that links reach.

    Each round takes the smallest label among neighbours, then the label of that label, until nothing changes. Labels
    are only ever grouped by minimum, so a node with very many links needs no gathering.
    """
    both = scratch.store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = scratch.store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        named = labels.withColumnRenamed("label", "old")
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        better = named.join(near, "node").select("node", "old", F.least("old", "near").alias("label"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = scratch.store(better.join(further, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = jumped.filter("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = jumped.select("node", "label")
        labels._scratch_path = jumped._scratch_path
        if not changed:
            return labels
