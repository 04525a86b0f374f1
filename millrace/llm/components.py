"""Connected components of an edge table: least labels, handed on along edges and by pointer jumping, each round written to the
shared folder. No vertex's edges meet in one task: labels are joined to edges, and minima are taken per task first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every vertex of an edge, the smallest vertex that it reaches."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), F.col("component").alias("far")), "v").groupBy("u").agg(F.min("far").alias("far"))
        moved = labels.join(near, labels["id"] == near["u"]).select("id", F.col("component").alias("old"), F.least("component", "far").alias("component"))
        target = labels.select(F.col("id").alias("root"), F.col("component").alias("jump"))
        jumped = moved.join(target, moved["component"] == target["root"]).select("id", "old", F.least("component", "jump").alias("component"))
        after = written(jumped, "labels")
        changed = after.where("component <> old").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels
