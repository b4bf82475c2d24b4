"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each linked node can reach.

    Each round takes the smallest label around a node (reduced before it is shuffled) and then the
    label of that label, so chains halve; it ends when no label changes. Every round is a written
    table. Links may repeat and point either way; null ends and self-links are ignored. Nodes
    without links are not in the result.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = cut_lineage(pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(
        F.min("b").alias("around")).select("node", F.least("node", "around").alias("label")))
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("around"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(
            F.min("around").alias("around"))
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "around").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("jumped"))
        step = cut_lineage(lower.join(jump, "via").select(
            "node", "old", F.least("via", "jumped").alias("label")))
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels
