"""Substring search over an inverted table of grams.

`build` writes each distinct three-character gram of a name beside the name's id, in buckets by a hash of the gram, and how many
names have each gram. A query reads the counts of its own grams, takes the rarest one's postings from that one bucket, and tests only
those names. A gram of very many names is spread over files of its bucket by Spark's own file sizes; it is read only by queries all of
whose grams are as common. Queries shorter than a gram have none, and scan the names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import relational as R

SIZE, BUCKETS = 3, 32


def grams(text: Column, size: int = SIZE) -> Column:
    """Distinct runs of `size` characters; none of a shorter text."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: i <= F.length(text) - size + 1)
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(size))))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def build(names: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """names: (id, name), normalised alike to the queries."""
    named = names.select("id", "name")
    postings = named.where(F.col("name").isNotNull()).select("id", "name", F.explode(grams(F.col("name"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    counts = postings.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    postings.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
    named.write.mode("overwrite").parquet(f"{path}/names")


def containing(spark: SparkSession, path: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, name) of the names that contain the query."""
    parts = sorted({query[i : i + SIZE] for i in range(len(query) - SIZE + 1)})
    if not parts:
        return spark.read.parquet(f"{path}/names").where(F.col("name").contains(query))
    own = spark.range(1).select(F.explode(F.array(*map(F.lit, parts))).alias("gram")).select("gram", _bucket(F.col("gram"), buckets).alias("bucket")).collect()
    counts = spark.read.parquet(f"{path}/counts").where(F.col("bucket").isin([r["bucket"] for r in own]) & F.col("gram").isin(parts))
    found = {r["gram"]: (r["n"], r["gram"], r["bucket"]) for r in counts.collect()}
    postings = spark.read.parquet(f"{path}/postings")
    if len(found) < len(parts):  # a gram that no name has
        return postings.select("id", "name").where(F.lit(False))
    _, gram, bucket = min(found.values())
    return postings.where((F.col("bucket") == bucket) & (F.col("gram") == gram)).select("id", "name").where(F.col("name").contains(query))


def search(spark: SparkSession, names_at: str, aliases_at: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, name, tier) as relational.search gives them, from an index of names (by entity) and one of aliases (id: the entity's, a row for
    each alias). Entities found by an alias alone are looked up by id."""
    if not query:
        return spark.read.parquet(f"{names_at}/names").withColumn("tier", F.lit(6))
    by_name = containing(spark, names_at, query, buckets)
    aliases = containing(spark, aliases_at, query, buckets).select(F.col("id").alias("owner"), F.col("name").alias("alias"))
    owners = aliases.select(F.col("owner").alias("id")).distinct().join(by_name.select("id"), "id", "left_anti")
    entities = by_name.unionByName(spark.read.parquet(f"{names_at}/names").join(owners, "id", "left_semi"))
    return R.search(entities, aliases, query, "id", "name", "owner", "alias")
