"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, component): for each end of an edge (a, b) the smallest id reachable from it.

    Every round gives a vertex the smallest label of its neighbours, then that
    label's own label, so the rounds grow with the logarithm of the longest path.
    Neighbours are reduced by min, never gathered. All joins are merge joins, as no side has a bound.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.hint("merge"), both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        step = labels.join(near.hint("merge"), "v").select("v", F.col("component").alias("was"), F.least("component", "near").alias("l"))
        roots = labels.select(F.col("v").alias("l"), F.col("component").alias("up"))
        new = checkpointed(step.join(roots.hint("merge"), "l", "left").select("v", "was", F.least("l", F.coalesce("up", "l")).alias("component")))
        if new.where("was <> component").isEmpty():
            return new.select("v", "component")
        labels = new.select("v", "component")
