"""Connected components of an edge list: minimum labels with pointer jumping.

Each round takes, for every node, the least label among its neighbours and itself and
then jumps to that label's own label, so a chain of n nodes takes about log2(n) rounds.
Labels live in the shared scratch folder; edges and labels are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node of its component.

    Self-loops and repeated edges are harmless; rows with a null end are ignored; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.put(both.distinct())
    labels = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "least").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = scratch.put(step.join(jump, "next").select("node", "label", F.least("next", "far").alias("next")))
        changed = moved.where("label <> next").limit(1).count()
        scratch.drop(labels)
        labels = moved.select("node", F.col("next").alias("label"))
        labels._scratch_path = moved._scratch_path
        if not changed:
            return labels
