"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import stored


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, label (the smallest node of its component) from edges (a, b).

    Each round a node takes the smallest label among its own and its neighbours', then the
    label of its label, so chains shorten by half and more; a round's labels are written to
    the shared folder. Minima are combined before the shuffle, so a node with many edges
    costs each task one row. Nodes without edges aren't listed.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        step = step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("label"), "was")
        step = stored(step, "cc-labels")
        labels = step.select("node", "label")
        if step.filter("label <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
