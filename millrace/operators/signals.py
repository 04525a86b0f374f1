"""Signals from nested vendor responses, hints from documents, and what is left to collect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

_ITEM = "struct<id:string,name:string,title:string,date:string,amount:string,round:string,winner:string,count:int>"
ENVELOPE = f"struct<responses:array<struct<tool:string,payload:struct<items:array<{_ITEM}>,sources:map<string,struct<items:array<{_ITEM}>>>,toolRisks:array<{_ITEM}>>>>>"
YEARS = 3


def items(rows: DataFrame, body: str = "body") -> DataFrame:
    """One row per item of an envelope {"responses": [{tool, payload}]}, wherever the payload holds it: items, sources.*.items or toolRisks."""
    opened = rows.select(*[c for c in rows.columns if c != body], F.explode(F.from_json(body, ENVELOPE)["responses"]).alias("r"))
    nested = F.flatten(F.transform(F.map_values("r.payload.sources"), lambda s: F.coalesce(s["items"], F.array().cast(f"array<{_ITEM}>"))))
    every = F.concat(*[F.coalesce(c, F.array().cast(f"array<{_ITEM}>")) for c in (F.col("r.payload.items"), nested, F.col("r.payload.toolRisks"))])
    return opened.select(*[c for c in rows.columns if c != body], F.col("r.tool").alias("tool"), F.explode(every).alias("item")).select("*", "item.*").drop("item")


def signals(found: DataFrame, owner: str, as_of: Column, keys: dict[str, str], aliases: DataFrame | None = None, terms: Sequence[str] = ()) -> DataFrame:
    """(owner, key, date, name, fingerprint) of items of known tools, not older than three years (undated ones count), that hold one of the
    terms where there are any. A bid counts only if its winner is one of the owner's aliases."""
    named = found.withColumn("key", F.element_at(F.create_map(*[F.lit(x) for pair in keys.items() for x in pair]), F.col("tool"))).where("key IS NOT NULL")
    label, day = F.coalesce("name", "title"), C.iso_date(F.col("date"))
    rows = named.withColumn("label", label).withColumn("day", day).where(day.isNull() | (day >= C.years_before(as_of, YEARS)))
    if terms:
        rows = rows.where((F.col("key") != "patent") | (C.keyword_hits(F.col("label"), list(terms)) > 0))
    if aliases is not None:
        won = rows.where("key = 'bid'").join(aliases.select(F.col("owner").alias(owner), F.col("alias").alias("winner")), [owner, "winner"], "left_semi")
        rows = rows.where("key <> 'bid'").unionByName(won.select(rows.columns))
    mark = F.sha2(F.concat_ws("\x00", owner, "key", F.coalesce("id", F.lit("")), F.coalesce("label", F.lit("")), F.coalesce(F.col("day").cast("string"), F.lit(""))), 256)
    return rows.select(owner, "key", F.col("day").alias("date"), "label", mark.alias("fingerprint")).dropDuplicates([owner, "fingerprint"])


def hints(documents: DataFrame, owner: str, order: str, text: str, fields: dict[str, Sequence[str]]) -> DataFrame:
    """Per owner and field, the first document (by order) that holds one of the field's terms."""
    tests = F.array_compact(F.array(*[F.when(C.keyword_hits(F.col(text), list(terms)) > 0, F.lit(name)) for name, terms in fields.items()]))
    return documents.select(owner, order, F.explode(tests).alias("field")).groupBy(owner, "field").agg(F.min(order).alias(order))


def still_to_collect(owners: DataFrame, owner: str, categories: Sequence[str], done: DataFrame) -> DataFrame:
    """Every owner and category that hasn't succeeded yet. Categories are a literal list, so the grid grows with the owners."""
    grid = owners.select(owner, F.explode(F.array(*map(F.lit, categories))).alias("category"))
    return grid.join(done.select(owner, "category"), [owner, "category"], "left_anti")


def site_queries(names: DataFrame, key: str, variants: str, sites: Sequence[str]) -> DataFrame:
    """`site:... "variant"` for every distinct variant of a name and every site, in order."""
    one = names.select(key, F.posexplode(F.array_distinct(variants)).alias("v", "variant"))
    return one.select(key, "v", "variant", F.posexplode(F.array(*map(F.lit, sites))).alias("s", "site")).select(key, F.concat(F.lit("site:"), F.col("site"), F.lit(' "'), F.col("variant"), F.lit('"')).alias("query"), (F.col("v") * len(sites) + F.col("s")).alias("position"))
