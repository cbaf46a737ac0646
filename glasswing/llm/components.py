"""Connected components over an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswing.llm.common import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of any orderable type to ``(node, label)``: the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the label's own
    label (pointer jumping), so that the rounds grow with the logarithm of the diameter. Every
    round is written to the shared folder; only the number of changes comes to the driver.
    Nodes without links don't appear. Self-links and repeated links do no harm. The result is a
    written table, which ``discard`` deletes.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "cc-labels")
    while True:
        heard = edges.join(labels, edges.b == labels.node).select(F.col("a").alias("node"), "label")
        least = heard.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("root"))
        before = labels.select(F.col("node"), F.col("label").alias("before"))
        step = least.join(up, least.label == up.via).select("node", F.least("label", "root").alias("label"))
        step = written(step.join(before, "node").select("node", "label", (F.col("label") != F.col("before")).alias("moved")), "cc-labels")
        discard(labels)
        moved, labels = step.where("moved").limit(1).count(), step.select("node", "label")
        labels.written_to = step.written_to
        if not moved:
            discard(edges)
            return labels
