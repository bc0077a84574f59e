"""Connected components of a graph given as pairs of numbers, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import stage


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is one node of the component.

    Each node points to its least neighbour or itself; pointers are followed to their ends by doubling; the
    graph of the ends is smaller by half at least. All steps are joins and aggregates; the driver sees
    counts alone. Loops and repeated edges do no harm; without edges there are no rows.
    """
    edges = stage(edges.select("a", "b").distinct())
    labels = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                            .select("node", F.least("node", "b").alias("label")))
        while True:  # follow the pointers to their ends
            ends = point.select(F.col("node").alias("label"), F.col("label").alias("next"))
            further = stage(point.join(ends, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
            point = further.select("node", "label")
            if not further.where("moved").head(1):
                break
        if labels is None:
            labels = point
        else:
            names = point.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = stage(labels.join(names, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        left = point.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = point.select(F.col("node").alias("b"), F.col("label").alias("y"))
        edges = stage(edges.join(left, "a").join(right, "b").where("x != y")
                            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not edges.head(1):
            return labels
