"""The versioned table: replays, failures, buckets that are left alone; and the search index."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import relational, search_index
from millrace.sources import versions
from millrace.sources.versions import VersionedTable

SCHEMA = "k long, v string, n int"
NEWEST = versions.newest(["k"], ["n"])


def rows(df):
    return sorted(map(tuple, df.collect()))


def batch(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_replays_change_nothing(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], 4)
    assert rows(table.read()) == []
    assert table.upsert(batch(spark, (1, "a", 1), (2, "b", 1)), 0, NEWEST)
    assert table.upsert(batch(spark, (2, "c", 2), (3, "d", 1), (1, "old", 0)), 1, NEWEST)
    want, manifest = [(1, "a", 1), (2, "c", 2), (3, "d", 1)], table.manifest()
    assert rows(table.read()) == want
    for n in (1, 0):
        assert not table.upsert(batch(spark, (1, "z", 9)), n, NEWEST)
    assert rows(table.read()) == want and table.manifest() == manifest
    again = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], 99)
    assert again.buckets == 4 and rows(again.read()) == want


def test_a_failed_batch_leaves_the_old_version(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], 4)
    table.upsert(batch(spark, (1, "a", 1)), 0, NEWEST)

    def failing(stored, new):
        return NEWEST(stored, new).withColumn("v", F.when(F.col("k") == 5, F.raise_error(F.lit("no"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="no"):
        table.upsert(batch(spark, (1, "x", 2), (5, "y", 1)), 1, failing)
    assert rows(table.read()) == [(1, "a", 1)]

    swap = table._swap
    table._swap = lambda manifest: (_ for _ in ()).throw(RuntimeError("lost before the swap"))
    with pytest.raises(RuntimeError):
        table.upsert(batch(spark, (1, "x", 2)), 1, NEWEST)
    table._swap = swap
    assert rows(table.read()) == [(1, "a", 1)]
    assert table.upsert(batch(spark, (1, "x", 2)), 1, NEWEST) and rows(table.read()) == [(1, "x", 2)]
    assert table.vacuum() >= 2 and rows(table.read()) == [(1, "x", 2)] and table.vacuum() == 0


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], 16)
    table.upsert(spark.range(500).selectExpr("id AS k", "'a' AS v", "1 AS n"), 7, NEWEST)
    before = table.manifest()["folders"]
    table.upsert(batch(spark, (3, "b", 2)), 8, NEWEST)
    after = table.manifest()["folders"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert table.read().count() == 500 and table.read().where("v = 'b'").count() == 1
    gone = lambda stored, new: stored.join(new, "k", "left_anti").select("k", "v", "n")
    table.upsert(spark.range(500).selectExpr("id AS k", "'a' AS v", "1 AS n"), 9, gone)
    assert table.read().count() == 0 and table.manifest()["folders"] == {}


def test_search_by_index_equals_a_scan(spark, tmp_path):
    rng = random.Random(2)
    words = ["ring", "red", "ringed", "bread", "zing", "gear", "ab", "añejo", "*.*"]
    names = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 4)))) for k in range(400)] + [(900, None)]
    aliases = [(k % 410, " ".join(rng.choice(words) for _ in range(2))) for k in range(300)]
    n, a = spark.createDataFrame(names, "id int, name string"), spark.createDataFrame(aliases, "id int, name string")
    search_index.build(n, f"file://{tmp_path}/n", 8)
    search_index.build(a, f"file://{tmp_path}/a", 8)
    for q in ("ring", "red ring", "ngedx", "ab", "ñej", "*.*", "", "d b", "g"):
        want = relational.search(n, a.select(F.col("id").alias("owner"), F.col("name").alias("alias")), q, "id", "name", "owner", "alias")
        assert sorted(map(str, search_index.search(spark, f"file://{tmp_path}/n", f"file://{tmp_path}/a", q, 8).collect())) == sorted(map(str, want.collect())), q


def test_few_files_are_read(spark, tmp_path):
    n = spark.range(3000).selectExpr("id", "concat('item ', hex(id * 7919), ' of ', cast(id AS string)) AS name")
    search_index.build(n, f"file://{tmp_path}/n", 16)
    every = len(spark.read.parquet(f"file://{tmp_path}/n/postings").inputFiles())
    found = search_index.containing(spark, f"file://{tmp_path}/n", "of 1234", 16)
    assert [r["id"] for r in found.collect()] == [1234]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,234)" in scan  # the rarest gram of the query
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("234")), F.lit(16))).first()[0]
    of_one = spark.read.parquet(f"file://{tmp_path}/n/postings").where(F.col("bucket") == bucket).select(F.input_file_name()).distinct().count()
    assert of_one * 4 < every
