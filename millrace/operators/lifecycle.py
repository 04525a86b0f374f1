"""Snapshot-driven lifecycle in batch form; millrace.streaming.lifecycle is the stateful form of the same rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import streaks

MISSES_TO_DEACTIVATE = 2


def stale(last_seen: Column, cutoff: Column) -> Column:
    return last_seen.isNull() | (last_seen < cutoff)


def expired(active: Column, managed: Column, last_seen: Column, as_of: Column, days: int = 30) -> Column:
    """Active, not managed, and last seen strictly before the limit."""
    return active & ~F.coalesce(managed, F.lit(False)) & (last_seen < as_of - F.make_dt_interval(days=F.lit(days)))


def in_order(snapshots: DataFrame, key: str, at: str) -> DataFrame:
    """applied = False for snapshots that are not newer than all that came before them (by arrival); they are kept, but change nothing."""
    before = Window.partitionBy(key).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(at).over(before)
    return snapshots.withColumn("applied", newest.isNull() | (F.col(at) > newest))


def absence(snapshots: DataFrame, key: str, order: list[str], seen: Column, complete: Column) -> DataFrame:
    """After each snapshot of a source: misses in a row (only complete snapshots count) and whether it is still active. A source is
    inactive from the second miss on, until it is seen again."""
    told = snapshots.withColumn("_seen", seen).where(F.col("_seen") | complete)
    runs = streaks(told, key, order, ~F.col("_seen"), "missing")
    return runs.withColumn("active", F.col("missing") < MISSES_TO_DEACTIVATE).drop("_seen")


def replays(commands: DataFrame, keys: list[str], digest: str, order: list[str]) -> DataFrame:
    """`outcome` of each command: the first of a key is applied; the same digest again is replayed, another one a conflict."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.first(digest).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return commands.withColumn("outcome", F.when(F.row_number().over(w) == 1, "applied").when(F.col(digest) == first, "replayed").otherwise("conflict"))
