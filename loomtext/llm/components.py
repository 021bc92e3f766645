"""Connected components of an edge list, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .runtime import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label): each vertex and the smallest of its component.  ``edges``: a table (a, b), a < b.

    Each round takes the least label in the neighbourhood and then the label of that label, so that the
    number of rounds grows with the logarithm of a component's breadth.  Every round is a written table.
    """
    both = scratch.table(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))), "both")
    labels = scratch.table(both.groupBy("v").agg(F.least("v", F.min("w")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("label").alias("least"))
        lower = labels.join(near, "v").select("v", "label", F.least("label", "least").alias("next"))
        over = labels.select(F.col("v").alias("next"), F.col("label").alias("jump"))
        after, moved = lower.join(over, "next", "left").select("v", "label", F.least("next", "jump").alias("lower")), Observation()
        found = scratch.table(after.observe(moved, F.coalesce(F.max(F.col("lower") < F.col("label")), F.lit(False)).alias("any")).select("v", F.col("lower").alias("label")), "labels")
        if not moved.get["any"]:
            return labels
        labels = found
