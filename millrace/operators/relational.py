"""Filters, tiers, semi and anti joins, grouped counts, paging, set operations and first / last wins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE_SIZE = 100


def matching(df: DataFrame, **equals) -> DataFrame:
    """Rows equal in every given column; columns given as None do not filter."""
    unknown = [c for c in equals if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    tests = [F.col(c) == F.lit(v) for c, v in equals.items() if v is not None]
    return df.where(reduce(and_, tests)) if tests else df


def page_bounds(page: int, page_size: int) -> tuple[int, int]:
    """(offset, limit) of a page, or ValueError."""
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be at least 1 and page_size from 1 to {MAX_PAGE_SIZE}")
    return (page - 1) * page_size, page_size


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page of the sorted rows: a bounded top-k, not a full sort."""
    offset, limit = page_bounds(number, size)
    return df.orderBy(*order).offset(offset).limit(limit)


def relevance(query: str, name: Column, alias_exact: Column, alias_prefix: Column, alias_inside: Column) -> Column:
    """0 exact name, 1 exact alias, 2 name starts so, 3 alias starts so, 4 inside the name, 5 inside an alias, else 6. All normalised alike before."""
    tiers = [name == query, alias_exact, name.startswith(query), alias_prefix, name.contains(query), alias_inside]
    out = F.when(tiers[0], 0)
    for tier, test in enumerate(tiers[1:], 1):
        out = out.when(test, tier)
    return out.otherwise(6)


def alias_flags(aliases: DataFrame, owner: str, alias: str, query: str) -> DataFrame:
    """Once per owner: whether an alias equals, starts with or contains the query."""
    c = F.col(alias)
    return aliases.where(c.contains(query)).groupBy(owner).agg(F.bool_or(c == query).alias("alias_exact"), F.bool_or(c.startswith(query)).alias("alias_prefix"), F.lit(True).alias("alias_inside"))


def search(entities: DataFrame, aliases: DataFrame, query: str, key: str, name: str, alias_owner: str, alias: str) -> DataFrame:
    """Entities whose name or an alias contains the query, with `tier`. Blank queries keep all rows at tier 6."""
    if not query:
        return entities.withColumn("tier", F.lit(6))
    flags = alias_flags(aliases, alias_owner, alias, query).withColumnRenamed(alias_owner, "_owner")
    joined = entities.join(flags, entities[key] == flags["_owner"], "left")
    no = F.lit(False)
    tier = relevance(query, F.col(name), *(F.coalesce(F.col(c), no) for c in ("alias_exact", "alias_prefix", "alias_inside")))
    return joined.withColumn("tier", tier).where("tier < 6").select(*entities.columns, "tier")


def any_keyword(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [F.lower(text).contains(w.lower()) for w in words])


def having_active(parents: DataFrame, children: DataFrame, key: str, child_key: str, active: Column) -> DataFrame:
    """Parents with an active child (EXISTS)."""
    return parents.join(children.where(active).select(F.col(child_key).alias(key)), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents.select(F.col(key).alias(child_key)), child_key, "left_anti")


def excluding(rows: DataFrame, *taken: tuple[DataFrame, str], key: str) -> DataFrame:
    """Rows whose key occurs in none of the given tables."""
    for table, column in taken:
        rows = rows.join(table.select(F.col(column).alias(key)), key, "left_anti")
    return rows


def bucket_counts(rows: DataFrame, key: str, **buckets: Column) -> DataFrame:
    """Per key, the rows of each bucket, in one pass."""
    return rows.groupBy(key).agg(*[F.count_if(test).alias(name) for name, test in buckets.items()])


def zero_filled(rows: DataFrame, column: str, domain: Sequence[str], name: str = "n") -> DataFrame:
    """Counts over a closed domain, zero where nothing occurs."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(d,) for d in domain], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias(name))
    return every.join(counts, column, "left").select(column, F.coalesce(name, F.lit(0)).alias(name))


def counts_by(rows: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    """Counts by value; null and empty count as `missing`."""
    value = F.when(F.col(column).isNull() | (F.col(column) == ""), missing).otherwise(F.col(column))
    return rows.groupBy(value.alias("name")).agg(F.count("*").alias("n"))


def top_counts(rows: DataFrame, column: str, k: int) -> DataFrame:
    return counts_by(rows, column).orderBy(F.desc("n"), "name").limit(k)


def shared_keys(rows: DataFrame, key: str, owner: str, at_least: int = 2) -> DataFrame:
    """Keys that several owners have."""
    return rows.groupBy(key).agg(F.countDistinct(owner).alias("owners")).where(F.col("owners") >= at_least)


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def rate(numerator: Column, denominator: Column) -> Column:
    """A share with four decimals, half up, or null over nothing."""
    return F.when(denominator != 0, F.round(numerator.cast("decimal(20,0)") / denominator.cast("decimal(20,0)"), 4)).cast("double")


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, half up, 0 over nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part * 100.0 / whole + 0.5)).cast("long")


def attach(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Parents with their children as an array of structs, sorted; an empty array where there are none."""
    nested = F.sort_array(F.collect_list(F.struct(*order, *[p for p in payload if p not in order])))
    own = children.groupBy(F.col(child_key).alias(key)).agg(nested.alias(name))
    joined = parents.join(own, key, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)))


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return _nth(rows, keys, order)


def last_wins(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Per key the value of the last row, and the first position, which stays its place."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.min(order[0]).alias("place"))


def _nth(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def best_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "best") -> DataFrame:
    """Per key the smallest struct of `order`: an aggregate, so it combines before the shuffle."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias(name)).select(*keys, f"{name}.*")


def with_suppressed(stored: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows, and others whose key isn't stored."""
    return stored.unionByName(other.join(stored.select(*keys), list(keys), "left_anti"))


def missing_from(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def validated(rows: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with `reasons`); a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    judged = rows.withColumn("reasons", broken)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One running SHA-256 over sorted ids, whatever their number."""
    digest, n, last, twice = hashlib.sha256(), 0, None, False
    for batch in batches:
        for one in batch.column(0).to_pylist():
            digest.update(one.encode() if n == 0 else b"\n" + one.encode())
            twice, last, n = twice or one == last, one, n + 1
    yield pa.record_batch([pa.array([digest.hexdigest()]), pa.array([n], pa.int64()), pa.array([twice])], names=["digest", "n", "twice"])


def fingerprint(rows: DataFrame, column: str) -> DataFrame:
    """One digest of a set of ids: sorted, joined by line ends; null if an id occurs twice. A digest of a sorted list is made in its
    order, so one task reads the ids (and nothing else of the rows) from an external sort, a batch at a time."""
    ids = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("id"))
    told = ids.repartition(1).sortWithinPartitions("id").mapInArrow(_digest, "digest string, n long, twice boolean")
    empty = F.sha2(F.lit(""), 256)
    return told.agg(F.when(~F.coalesce(F.bool_or("twice"), F.lit(False)), F.coalesce(F.max_by("digest", "n"), empty)).alias("fingerprint"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
