"""Connected components without collecting a group or the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged


#: Edges that a task tells apart at once: what it holds doesn't grow with the table.
EDGES = 500_000


def _cut(df: DataFrame) -> DataFrame:
    """Lineage ends in a table in the shared folder."""
    return staged(df, "round")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): least label by edges and pointer jumping, rounds in the logarithm of a path's length."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    tasks = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), both.count() // EDGES + 1)
    both = _cut(both.repartition(tasks, "u", "v").distinct())
    labels = _cut(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("component")))
    while True:
        far = labels.select(F.col("id").alias("v"), F.col("component").alias("far"))
        near = both.join(far, "v").groupBy(F.col("u").alias("id")).agg(F.min("far").alias("far"))
        moved = labels.withColumnRenamed("component", "old").join(near, "id").select("id", "old", F.least("old", "far").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("component").alias("jump"))
        after = _cut(moved.join(jump, "root").select("id", "old", F.least("root", "jump").alias("component")))
        done = after.where("component <> old").isEmpty()
        labels = after.select("id", "component")
        if done:
            return labels


def grouped_by_shared_keys(rows: DataFrame, identity: str, keys: list[str]) -> DataFrame:
    """Rows that share a value of any key, directly or through others, are one group: (id, component). Each key value links its rows to
    its smallest one, so edges grow with the rows."""
    edges = None
    for key in keys:
        least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(identity).alias("a"))
        own = rows.join(least, key).select("a", F.col(identity).alias("b"))
        edges = own if edges is None else edges.unionByName(own)
    return connected_components(edges)
