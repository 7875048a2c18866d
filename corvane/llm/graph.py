"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .corpus import written


def components(edges: DataFrame, into: str | None = None) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that edges reach.

    Each round takes the smallest label among the neighbours or the label of the own
    label, whichever is smaller, so the rounds needed grow with the logarithm of a
    path's length; each is written to the shared folder, which cuts the lineage. Labels
    are written before they are joined, so that a node with very many edges is split by
    the skew join.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", into)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels", into)
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = labels.join(seen, "node").join(jump, "component", "left")
        moved = Observation()
        step = step.select("node", F.least("near", "component", "far").alias("to"), "component").observe(moved, F.coalesce(F.max(F.col("to") < F.col("component")), F.lit(False)).alias("moved"))
        labels = written(step.select("node", F.col("to").alias("component")), "labels", into)
        if not moved.get["moved"]:
            return labels
