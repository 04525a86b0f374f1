"""Proposals without a predecessor stay where they are: none of them is dealt by that key, nor any by its manifest."""

from pyspark.sql import functions as F

from millrace.operators import rounds


def test_null_predecessors_and_few_manifests_are_not_dealt(spark):
    sha = lambda c: F.sha2(c, 256)
    n = F.col("id")
    rows = spark.range(4000).select(
        n.alias("round_id"), sha((n % 2).cast("string")).alias("manifest_version"), F.concat(F.lit("round-"), n.cast("string")).alias("name"), sha(F.lit("c")).alias("config_fingerprint"), sha(F.lit("m")).alias("model_fingerprint"),
        F.when(n % 1000 == 7, n - 3).alias("predecessor_id"), F.timestamp_seconds(n).alias("started_at"), F.lit(None).cast("string").alias("membership_fingerprint"), F.lit(None).cast("int").alias("member_count"),
    )
    stored, manifests = rows.where("round_id % 5 = 0"), rows.select(F.col("manifest_version").alias("version")).distinct()
    out = rounds.round_outcomes(rows.where("round_id % 5 <> 0"), stored, manifests)
    got = {r["outcome"]: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert got == {"created": 3200 - 4, "unknown_predecessor": 4}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(" in plan and "isnotnull(" in plan and "strategy=broadcast" in plan
