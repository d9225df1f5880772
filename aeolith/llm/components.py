"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolith.llm.common import removed, stored

#: Doublings of the paths to smaller neighbours in a round.
JUMPS = 3


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """links (a, b) to (node, component), component being the smallest node reachable; nodes without links don't appear. Also its path.

    Every round each node points at its smallest neighbour if that is smaller; pointers are followed a few doublings
    and the graph is contracted along them, until no link is left. Rounds grow with the logarithm of the longest path.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, at = stored(edges, "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels, labels_at = stored(nodes.select("node", F.col("node").alias("component")), "labels")
    while not edges.isEmpty():
        point = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        point, point_at = stored(point, "point")
        old = [point_at]
        for _ in range(JUMPS):
            ahead = point.select(F.col("node").alias("to"), F.col("to").alias("far"))
            point, point_at = stored(point.join(ahead, "to", "left").select("node", F.coalesce("far", "to").alias("to")), "point")
            old.append(point_at)
        a = point.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = point.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        next_ = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        next_ = next_.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges, next_at = stored(next_, "edges")
        c = point.select(F.col("node").alias("component"), F.col("to").alias("tc"))
        labels, new_at = stored(labels.join(c, "component", "left").select("node", F.coalesce("tc", "component").alias("component")), "labels")
        removed(spark, at, labels_at, *old)
        at, labels_at = next_at, new_at
    removed(spark, at)
    return labels, labels_at
