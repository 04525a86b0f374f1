"""Samples, digests and stages that gather no stratum in a task."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.operators import ranking, relational, windows
from millrace.plans.registry import QUERIES


def by_hash(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.sha256(f"{i}:{seed}".encode()).hexdigest(), i))


def test_one_stratum(spark, monkeypatch):
    """Of 40000 rows of one stratum only those at the edge are put in order."""
    edges, inner = [], windows._edges

    def watched(hashed, strata, seats):
        out = inner(hashed, strata, seats)
        edge = out.first()["_edge"]
        edges.append(hashed.where(F.col("_head") == edge).count())
        return out

    monkeypatch.setattr(windows, "_edges", watched)
    df = spark.range(40_000, numPartitions=4)
    for seats in (1, 777, 40_000):
        got = {r["id"] for r in windows.stratified_sample(df, F.lit("all"), "id", seats, "s").collect()}
        assert got == set(by_hash(range(40_000), "s")[:seats])
    assert max(edges) < 20


@pytest.mark.parametrize("share", ["0.1", "0.000001", "1"])
def test_shares_of_strata(spark, share):
    df = spark.range(3000).select("id", F.when(F.col("id") < 5, "few").when(F.col("id") < 6, None).otherwise((F.col("id") % 3).cast("string")).alias("s"))
    got = {}
    for r in windows.share_sample(df, ["s"], "id", share, "z").collect():
        got.setdefault(r["s"], set()).add(r["id"])
    strata = {}
    for r in df.collect():
        strata.setdefault(r["s"], []).append(r["id"])
    strata.pop(None)  # a null stratum is none
    from decimal import ROUND_CEILING, Decimal

    want = {s: set(by_hash(ids, "z")[: max(1, int((Decimal(share) * len(ids)).to_integral_value(ROUND_CEILING)))]) for s, ids in strata.items()}
    assert got == want


def test_fingerprint_of_a_million_ids(spark):
    df = spark.range(1_000_000, numPartitions=5)
    want = hashlib.sha256("\n".join(sorted(map(str, range(1_000_000)))).encode()).hexdigest()
    assert tuple(relational.fingerprint(df, "id").first()) == (want, 1_000_000)
    twice = df.limit(1000).union(spark.range(1))
    assert tuple(relational.fingerprint(twice, "id").first()) == (None, 1001)
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(relational.fingerprint(df.where("false"), "id").first()) == (nothing, 0)
    assert tuple(relational.fingerprint(spark.createDataFrame([(None,), ("é",)], "id string"), "id").first()) == (hashlib.sha256("é".encode()).hexdigest(), 1)


def test_small_stages_merge_by_two_counts(spark):
    rows = [("early",)] * 4 + [("mature",)] * 5 + [("growth",)] * 2 + [(None,)]
    out = ranking.merge_small_stages(spark.createDataFrame(rows, "stage string"))
    assert {r["stage"]: r["count"] for r in out.groupBy("stage").count().collect()} == {"growth": 6, "mature": 5, None: 1}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_calibration_with_and_without_broadcast(spark, monkeypatch):
    from millrace import staging

    few = sorted(map(tuple, QUERIES["calibrated_ranking"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(staging, "FEW", 0)
    assert sorted(map(tuple, QUERIES["calibrated_ranking"](spark, "/root/testdata/sf0.001").collect())) == few
