"""Upserts as full joins: what is stored and what comes in give the new table, counters and conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """All keys of both tables. A rule per column: `overwrite` (incoming wins where the key comes in), `fill` (incoming where not null),
    `keep` (stored where not null), `longer`, `earliest`, `latest`. `change` is created, updated or unchanged."""
    s = stored.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in rules], F.lit(True).alias("_s"))
    i = incoming.select(*keys, *[F.col(c).alias(f"_i_{c}") for c in rules], F.lit(True).alias("_i"))
    both = s.join(i, list(keys), "full")

    def value(column: str, rule: str) -> Column:
        old, new = F.col(f"_s_{column}"), F.col(f"_i_{column}")
        if rule == "overwrite":
            return F.when(F.col("_i"), new).otherwise(old)
        if rule == "fill":
            return F.coalesce(new, old)
        if rule == "keep":
            return F.coalesce(old, new)
        if rule == "longer":
            return F.when(old.isNull() | (F.length(new) > F.length(old)), F.coalesce(new, old)).otherwise(old)
        if rule in ("earliest", "latest"):
            return F.least(old, new) if rule == "earliest" else F.greatest(old, new)
        raise ValueError(f"no such rule: {rule}")

    values = [value(c, r).alias(c) for c, r in rules.items()]
    same = F.lit(True)
    for c, r in rules.items():
        same = same & value(c, r).eqNullSafe(F.col(f"_s_{c}"))
    change = F.when(F.col("_s").isNull(), "created").when(F.col("_i").isNull() | same, "unchanged").otherwise("updated")
    return both.select(*keys, *values, change.alias("change"))


def newest(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """One row per key: the incoming one if it is not older."""
    every = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    value = F.struct(*[c for c in stored.columns if c not in keys])
    return every.groupBy(*keys).agg(F.max_by(value, F.struct(at, "_new")).alias("row")).select(*keys, "row.*")


def classified(incoming: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """`outcome` of each incoming row: create, replay (same digest stored) or conflict."""
    known = stored.select(F.col(key), F.col(digest).alias("_known"))
    joined = incoming.join(known, key, "left")
    return joined.withColumn("outcome", F.when(F.col("_known").isNull(), "create").when(F.col("_known") == F.col(digest), "replay").otherwise("conflict")).drop("_known")


def owner_conflicts(wanted: DataFrame, owned: DataFrame, name: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """(names to add, names that another owner has)."""
    other = owned.select(F.col(name), F.col(owner).alias("_owner"))
    joined = wanted.join(other, name, "left")
    return joined.where(F.col("_owner").isNull()).drop("_owner"), joined.where(F.col("_owner") != F.col(owner)).withColumnRenamed("_owner", "stored_owner")


def with_primary(rows: DataFrame, owner: str, order: Sequence[str]) -> DataFrame:
    """Exactly one row of each owner is primary: the first by `order`."""
    first = rows.groupBy(owner).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(first, owner).withColumn("is_primary", F.struct(*order) == F.col("_first")).drop("_first")


def resolved(rows: DataFrame, name: str, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """`id` by canonical name, else by alias. Both tables are (name, id), a name once."""
    by_name, by_alias = canonical.select(F.col("name").alias(name), F.col("id").alias("_a")), aliases.select(F.col("name").alias(name), F.col("id").alias("_b"))
    return rows.join(by_name, name, "left").join(by_alias, name, "left").withColumn("id", F.coalesce("_a", "_b")).drop("_a", "_b")


def appended_members(members: DataFrame, extra: DataFrame, group: str, row: str, identity: str) -> DataFrame:
    """Members and those of `extra` that are not yet there, with row numbers that go on from the largest."""
    new = extra.join(members.select(group, identity), [group, identity], "left_anti")
    most = members.groupBy(group).agg(F.max(row).alias("_most"))
    numbered = new.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(identity))).join(most, group, "left")
    return members.select(group, identity, row).unionByName(numbered.select(group, identity, (F.coalesce("_most", F.lit(0)) + F.col("_n")).alias(row)))


def verified_by_sources(facts: DataFrame, keys: Sequence[str], source: str, at_least: int = 2) -> DataFrame:
    """Per fact the number of independent sources, and whether they are enough."""
    return facts.groupBy(*keys).agg(F.countDistinct(source).alias("sources")).withColumn("verified", F.col("sources") >= at_least)
