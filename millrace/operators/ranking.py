"""Scores, stages, calibration, eligibility and reasons of a ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import broadcast_if_few, staged
from .windows import dense_positions, midranks

#: Points a component can give (fixed values), in declared order.
MAXIMA = {"ai_core": 30, "market_validation": 25, "growth_momentum": 20, "industry_influence": 15, "reliability": 10}
EARLY, GROWTH, MATURE, SMALLEST_STAGE = "early", "growth", "mature", 5


def stage(founded: Column, staff: Column, as_of: Column) -> Column:
    """growth without a date; early below 3 years and 100 staff; mature from 10 years or 500 staff; else growth."""
    age = F.greatest(F.lit(0), F.datediff(as_of, founded))
    return F.when(founded.isNull(), GROWTH).when((age < 3 * 365) & (staff < 100), EARLY).when((age >= 10 * 365) | (staff >= 500), MATURE).otherwise(GROWTH)


def merge_small_stages(rows: DataFrame, column: str = "stage") -> DataFrame:
    """Early and mature stages with fewer than five members become growth; growth never merges. Two counts are all that is gathered."""
    sizes = {stage: F.count_if(F.col(column) == stage) for stage in (EARLY, MATURE)}
    small = [stage for stage, n in rows.agg(*[n.alias(s) for s, n in sizes.items()]).first().asDict().items() if n < SMALLEST_STAGE]
    return rows.withColumn(column, F.when(F.col(column).isin(small), GROWTH).otherwise(F.col(column))) if small else rows


def capped_counts(signals: DataFrame, key: str, **rules: tuple[Column, int, int]) -> DataFrame:
    """Per key and component: points for each matching signal, up to a cap."""
    return signals.groupBy(key).agg(*[F.least(F.count_if(test) * points, F.lit(cap)).alias(name) for name, (test, points, cap) in rules.items()])


def calibrated(rows: DataFrame, stage_column: str, components: dict[str, int]) -> DataFrame:
    """Each raw component replaced by its mid-rank percentile within the stage times its maximum, rounded half to even, and `total`. Points
    belong to distinct values; where those are few (counted first), rows meet them in place."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("component"), F.col(name).cast("double").alias("value")) for name in components])).alias("c")
    shares = staged(midranks(rows.select(stage_column, each).select(stage_column, "c.*"), "value", ["component", stage_column], "share"), "shares")
    beside = broadcast_if_few(shares)
    out = rows
    for name, most in components.items():
        own = shares.where(F.col("component") == name).select(stage_column, F.col("value").alias("_value"), F.bround(F.col("share") * most).cast("long").alias("_points"))
        met = out.withColumn("_value", F.col(name).cast("double")).join(beside(own), [stage_column, "_value"], "left")
        out = met.withColumn(name, F.coalesce("_points", F.lit(0).cast("long"))).drop("_value", "_points")
    return out.withColumn("total", sum((F.col(c) for c in components), F.lit(0)))


def eligibility(flags: Sequence[str], required: str, at_least: int = 4) -> tuple[Column, Column]:
    """(eligible, reasons): the required flag must be set, and so must `at_least` of all."""
    covered = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    reasons = F.array_compact(F.array(F.when(~F.col(required), f"missing_{required}"), F.when(covered < at_least, "evidence_coverage")))
    return F.size(reasons) == 0, reasons


def missing(flags: Sequence[str]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(~F.col(f), f) for f in flags])))


def reason(components: Sequence[str]) -> Column:
    """The component with the largest score; of equal ones the first as declared."""
    top = F.greatest(*[F.col(c) for c in components])
    out = F.when(F.col(components[0]) == top, components[0])
    for c in components[1:]:
        out = out.when(F.col(c) == top, c)
    return out


def full_where_present(required: Sequence[str], present: Column, most: int) -> Column:
    """All points of a component if every required field is there, else none."""
    return F.when(F.size(F.array_except(F.array(*map(F.lit, required)), present)) == 0, most).otherwise(0)


def gaps(categories: Sequence[str], fresh: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, categories)), fresh)


def ranked(rows: DataFrame, eligible: Column, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """`rank`: 1..n over eligible rows only (of the same `within`), null for the others."""
    told = rows.withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
    placed = dense_positions(told.where("_eligible"), order, "rank", within).withColumn("rank", F.col("rank") + 1)
    return placed.unionByName(told.where("NOT _eligible").withColumn("rank", F.lit(None).cast(placed.schema["rank"].dataType))).drop("_eligible")


def confidence_tier(source: Column, has_website: Column) -> Column:
    return F.when(source.isin("official", "registry") & has_website, "high").when(source.isin("official", "registry", "media") | has_website, "medium").otherwise("low")


def decided(rules: Sequence[tuple[Column, str, str]], otherwise: tuple[str, str]) -> tuple[Column, Column]:
    """(status, reason) of the first rule that holds."""
    status, why = F.lit(otherwise[0]), F.lit(otherwise[1])
    for test, s, r in reversed(rules):
        status, why = F.when(test, s).otherwise(status), F.when(test, r).otherwise(why)
    return status, why


def entry_score(domain: Column, mention: Column, similarity: Column, platform: Column, known: Column) -> Column:
    """Sum of weights, at most 1, three decimals half to even."""
    near = F.when(similarity >= 90, 0.30).when(similarity >= 75, 0.22).when(similarity >= 60, 0.10).otherwise(0.0)
    total = F.when(domain == "same", 0.45).when(domain == "related", 0.25).otherwise(0.0) + F.when(mention, 0.25).otherwise(0.0) + near + F.when(platform, 0.05).otherwise(0.0) + F.when(known, 0.20).otherwise(0.0)
    return F.bround(F.least(F.lit(1.0), total), 3)
