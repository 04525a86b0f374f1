"""Coverage of entities by snapshots: the report, and a status for each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import rate
from .windows import latest


def window_start(as_of: str, hours: int) -> Column:
    if hours < 1:
        raise ValueError("the window must be at least an hour")
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))


def coverage_report(entries: DataFrame, snapshots: DataFrame, as_of: str, hours: int) -> DataFrame:
    """One row of counts and rates.

    entries: (owner, entry, active); snapshots: (entry, at, created, id, succeeded, complete, empty). A snapshot qualifies if it succeeded,
    is complete and lies in the window, both ends included; the last qualifying one of an entry counts. An owner is enumerated if one of its
    active entries has one, and confirmed empty if all of them have one and each is empty."""
    start, end = window_start(as_of, hours), F.lit(as_of).cast("timestamp_ntz")
    active = entries.where("active").select("owner", "entry").distinct()
    qualifying = latest(snapshots.where(F.col("succeeded") & F.col("complete") & F.col("at").between(start, end)), ["entry"], ["at", "created", "id"])
    per_owner = active.join(qualifying.select("entry", "empty"), "entry", "left").groupBy("owner").agg(F.count("*").alias("entries"), F.count("empty").alias("qualified"), F.count_if(~F.col("empty")).alias("filled"))
    owners = entries.agg(F.countDistinct("owner").alias("target"))
    counts = per_owner.agg(F.count("*").alias("active"), F.count_if(F.col("qualified") > 0).alias("enumerated"), F.count_if((F.col("qualified") == F.col("entries")) & (F.col("filled") == 0)).alias("confirmed_empty"), F.coalesce(F.sum("qualified"), F.lit(0)).alias("entries_enumerated"))
    both = owners.crossJoin(counts)  # one row each
    return both.select(
        "target", "active", "enumerated", "confirmed_empty", "entries_enumerated",
        rate(F.col("active"), F.col("target")).alias("entry_rate"), rate(F.col("enumerated"), F.col("active")).alias("enumeration_rate"),
        rate(F.col("enumerated"), F.col("target")).alias("refresh_rate"), rate(F.col("confirmed_empty"), F.col("enumerated")).alias("empty_rate"),
    )


def entity_status(snapshots: DataFrame, key: str, as_of: str, fresh_hours: int = 24) -> DataFrame:
    """(key, status, fresh, reason). snapshots: (key, at, id, status, complete, empty). The last snapshot decides: a failed one hides an older
    success, which then only tells whether anything was ever known."""
    row = F.struct("at", "id", "status", "complete", "empty")
    last = snapshots.groupBy(key).agg(F.max_by(row, F.struct("at", "id")).alias("last"), F.max_by(row, F.when(F.col("status") == "succeeded", F.struct("at", "id"))).alias("ok"))
    fresh = F.coalesce(F.col("ok.at") >= window_start(as_of, fresh_hours), F.lit(False))
    good = F.col("last.status") == "succeeded"
    status = F.when(~good & F.col("ok").isNull(), "never_listed").when(~good, "failed").when(~F.col("last.complete"), "partial").when(F.col("last.empty"), "confirmed_empty").otherwise("listed")
    return last.select(key, status.alias("status"), fresh.alias("fresh"), F.when(~good, F.col("last.status")).when(~fresh, "stale").alias("reason"))
