"""Scoring, calibration, sampling and allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as K
from ..operators import relational as R
from ..operators import windows as W
from .base import Tables, query

AS_OF = "2001-01-01"
PARTS = {"ai_core": 30, "market_validation": 25, "growth_momentum": 20}


def raw(t: Tables):
    """Customers scored from their orders."""
    o = t.orders
    scores = K.capped_counts(o, "o_custkey", ai_core=(o["o_orderstatus"] == "F", 3, 30), market_validation=(o["o_totalprice"] > 250000, 5, 25), growth_momentum=(o["o_orderpriority"] == "1-URGENT", 4, 20))
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("founded"), F.count("*").alias("staff"))
    joined = scores.join(first, "o_custkey")
    named = joined.withColumn("stage", K.stage(F.to_date("founded"), F.col("staff") * 20, F.lit(AS_OF).cast("date")))
    return K.merge_small_stages(named)


_RAW = f"""
r AS (SELECT o_custkey, least(3 * count(*) FILTER (WHERE o_orderstatus = 'F'), 30) AS ai_core, least(5 * count(*) FILTER (WHERE o_totalprice > 250000), 25) AS market_validation,
  least(4 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), 20) AS growth_momentum, greatest(0, date_diff('day', min(o_orderdate)::DATE, DATE '{AS_OF}')) AS age, 20 * count(*) AS staff FROM orders GROUP BY 1),
s0 AS (SELECT *, CASE WHEN age < 1095 AND staff < 100 THEN 'early' WHEN age >= 3650 OR staff >= 500 THEN 'mature' ELSE 'growth' END AS st FROM r),
s AS (SELECT * EXCLUDE (st), CASE WHEN st <> 'growth' AND count(*) OVER (PARTITION BY st) < 5 THEN 'growth' ELSE st END AS stage FROM s0)
"""
_MID = "CASE WHEN {0} <= 0 THEN 0.0 WHEN count(*) OVER (PARTITION BY stage) = 1 THEN 1.0 ELSE (rank() OVER (PARTITION BY stage ORDER BY {0}) - 1 + count(*) OVER (PARTITION BY stage, {0}) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY stage) END"


@query(f"WITH {_RAW} SELECT o_custkey, ai_core, market_validation, growth_momentum FROM s")
def signal_raw_scores(t: Tables):
    return raw(t).select("o_custkey", *PARTS)


@query(f"WITH {_RAW} SELECT o_custkey, stage FROM s")
def stage_classes(t: Tables):
    return raw(t).select("o_custkey", "stage")


@query(f"WITH {_RAW} SELECT o_custkey, stage, round({_MID.format('ai_core')}, 6) AS percentile FROM s")
def stage_percentiles(t: Tables):
    return W.with_midrank(raw(t), "ai_core", ["stage"], "percentile").select("o_custkey", "stage", F.round("percentile", 6).alias("percentile"))


_CAL = f"c AS (SELECT o_custkey, stage, {', '.join(f'round_even({_MID.format(c)} * {m}, 0)::BIGINT AS {c}' for c, m in PARTS.items())} FROM s)"


@query(f"WITH {_RAW}, {_CAL} SELECT o_custkey, stage, ai_core, market_validation, growth_momentum, ai_core + market_validation + growth_momentum AS total FROM c")
def calibrated_ranking(t: Tables):
    return K.calibrated(raw(t), "stage", PARTS).select("o_custkey", "stage", *PARTS, "total")


@query(f"WITH {_RAW}, {_CAL} SELECT o_custkey, CASE WHEN ai_core >= market_validation AND ai_core >= growth_momentum THEN 'ai_core' WHEN market_validation >= growth_momentum THEN 'market_validation' ELSE 'growth_momentum' END AS reason FROM c")
def ranking_reason(t: Tables):
    return K.calibrated(raw(t), "stage", PARTS).select("o_custkey", K.reason(list(PARTS)).alias("reason"))


@query(f"WITH {_RAW}, {_CAL} SELECT o_custkey, stage, CASE WHEN ai_core > 0 THEN row_number() OVER (PARTITION BY stage, ai_core > 0 ORDER BY ai_core + market_validation + growth_momentum DESC, ai_core DESC, o_custkey) END AS rank FROM c")
def eligible_rank(t: Tables):
    done = K.calibrated(raw(t), "stage", PARTS)
    ordered = done.select("o_custkey", "stage", "ai_core", (-F.col("total")).alias("first"), (-F.col("ai_core")).alias("second"))
    return K.ranked(ordered, F.col("ai_core") > 0, ["first", "second", "o_custkey"], ["stage"]).select("o_custkey", "stage", F.col("rank").cast("long").alias("rank"))


_FLAGS = ["ai", "bought", "signed", "viewed", "large"]


@query("""
WITH f AS (SELECT user_id, bool_or(event_type = 'click' AND value > 40) AS ai, bool_or(event_type = 'purchase' AND value > 20) AS bought, bool_or(event_type = 'signup' AND value > 20) AS signed, bool_or(event_type = 'view' AND value > 20) AS viewed, bool_or(value > 90) AS large FROM events GROUP BY 1)
SELECT user_id, ai AND (ai::INT + bought::INT + signed::INT + viewed::INT + large::INT) >= 4 AS eligible,
  concat_ws(',', CASE WHEN NOT ai THEN 'missing_ai' END, CASE WHEN (ai::INT + bought::INT + signed::INT + viewed::INT + large::INT) < 4 THEN 'evidence_coverage' END) AS reasons,
  array_to_string(list_sort(list_filter([CASE WHEN NOT ai THEN 'ai' END, CASE WHEN NOT bought THEN 'bought' END, CASE WHEN NOT signed THEN 'signed' END, CASE WHEN NOT viewed THEN 'viewed' END, CASE WHEN NOT large THEN 'large' END], lambda x: x IS NOT NULL)), ',') AS missing FROM f
""")
def eligibility(t: Tables):
    kind, value = F.col("event_type"), F.col("value")
    tests = {"ai": (kind == "click") & (value > 40), "bought": (kind == "purchase") & (value > 20), "signed": (kind == "signup") & (value > 20), "viewed": (kind == "view") & (value > 20), "large": value > 90}
    flags = t.events.groupBy("user_id").agg(*[F.bool_or(test).alias(name) for name, test in tests.items()])
    ok, reasons = K.eligibility(_FLAGS, "ai")
    return flags.select("user_id", ok.alias("eligible"), F.array_join(reasons, ",").alias("reasons"), F.array_join(K.missing(_FLAGS), ",").alias("missing"))


@query("SELECT user_id, CASE WHEN count(DISTINCT event_type) FILTER (WHERE event_type IN ('view', 'click', 'signup') AND value > 30) = 3 THEN 20 ELSE 0 END AS points, array_to_string(list_sort(list_filter(['click', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(coalesce(list(DISTINCT event_type) FILTER (WHERE value > 30), []), x))), ',') AS gaps FROM events GROUP BY 1")
def first_pass_points(t: Tables):
    seen = t.events.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 30, F.col("event_type"))).alias("seen"))
    gaps = F.array_join(F.array_sort(K.gaps(["click", "purchase", "signup", "view"], F.col("seen"))), ",")
    return seen.select("user_id", K.full_where_present(["view", "click", "signup"], F.col("seen"), 20).alias("points"), gaps.alias("gaps"))


_QUINTILE = "(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) * 5 // count(*) OVER (PARTITION BY c_nationkey)"


@query(f"SELECT c_custkey, ({_QUINTILE})::INT AS quintile FROM customer")
def score_quintiles(t: Tables):
    return W.with_bucket(t.customer, 5, ["c_acctbal", "c_custkey"], "quintile", ["c_nationkey"]).select("c_custkey", "quintile")


@query(f"""
WITH q AS (SELECT c_custkey, c_mktsegment || '|' || c_nationkey || '|score_q' || ({_QUINTILE}) AS stratum FROM customer),
n AS (SELECT stratum, count(*) AS n FROM q GROUP BY 1), a AS (SELECT *, sum(n) OVER () AS total FROM n),
b AS (SELECT *, n * 200 // total AS base, n * 200 % total AS rest FROM a), s AS (SELECT *, row_number() OVER (ORDER BY rest DESC, stratum) AS place, 200 - sum(base) OVER () AS more FROM b),
k AS (SELECT q.*, row_number() OVER (PARTITION BY stratum ORDER BY sha256(c_custkey || ':seed'), c_custkey) AS place FROM q)
SELECT c_custkey, stratum FROM k JOIN (SELECT stratum, base + CASE WHEN place <= more THEN 1 ELSE 0 END AS seats FROM s) USING (stratum) WHERE place <= seats
""")
def stratified_sample(t: Tables):
    bucket = W.with_bucket(t.customer, 5, ["c_acctbal", "c_custkey"], "q", ["c_nationkey"])
    label = F.concat(F.col("c_mktsegment"), F.lit("|"), F.col("c_nationkey").cast("string"), F.lit("|score_q"), F.col("q").cast("string"))
    return W.stratified_sample(bucket, label, "c_custkey", 200, "seed").select("c_custkey", "stratum")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id || ':audit'), doc_id) AS rn, greatest(1, ceil(count(*) OVER (PARTITION BY source) * 0.05::DECIMAL(10, 6))) AS take FROM documents) WHERE rn <= take")
def audit_sample(t: Tables):
    return W.share_sample(t.documents.select("doc_id", "source"), ["source"], "doc_id", "0.05", "audit")


@query("""
WITH n AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT *, 40 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY n DESC, stratum) <= 40 % count(*) OVER () THEN 1 ELSE 0 END AS floor_seats FROM n),
r AS (SELECT *, n - floor_seats AS rest, sum(n - floor_seats) OVER () AS total FROM f), b AS (SELECT *, rest * 60 // total AS base, rest * 60 % total AS part FROM r),
s AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY part DESC, stratum) <= 60 - sum(base) OVER () THEN 1 ELSE 0 END AS share_seats FROM b)
SELECT stratum, n, floor_seats, share_seats::BIGINT AS share_seats, (floor_seats + share_seats)::BIGINT AS seats, floor_seats + share_seats <= n AS feasible FROM s
""")
def quota_allocation(t: Tables):
    counts = t.customer.groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count("*").alias("n"))
    return W.floor_and_share(counts, "n", 100)


@query("""
WITH k AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) AS turn FROM supplier)
SELECT s_suppkey, row_number() OVER (ORDER BY turn, s_nationkey) AS position FROM k
""")
def diversity_members(t: Tables):
    return W.round_robin(t.supplier.select("s_suppkey", "s_nationkey", "s_name"), ["s_nationkey"], ["s_name", "s_suppkey"]).select("s_suppkey", F.col("position").cast("long").alias("position"))


@query("""
WITH c AS (SELECT p_name, arg_min(p_partkey, (p_size, p_partkey)) AS id, min(p_brand) AS brand FROM part GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY p_name, id) AS turn FROM c), o AS (SELECT *, row_number() OVER (ORDER BY turn, brand) AS position FROM k)
SELECT id, position, sha256((SELECT string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR) FROM o WHERE position <= 30)) AS version FROM o WHERE position <= 30
""")
def freeze_manifest(t: Tables):
    reps = t.part.groupBy("p_name").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("id"), F.min("p_brand").alias("brand"))
    chosen = W.round_robin(reps, ["brand"], ["p_name", "id"]).where("position <= 30")
    version = R.fingerprint(chosen, "id").select(F.col("fingerprint").alias("version"))
    return chosen.crossJoin(F.broadcast(version)).select("id", F.col("position").cast("long").alias("position"), "version")


@query("SELECT d.doc_id, CASE WHEN source IN ('src0', 'src1') AND quality = 1 THEN 'high' WHEN source IN ('src0', 'src1', 'src2') OR coalesce(quality = 1, false) THEN 'medium' ELSE 'low' END AS tier FROM documents d LEFT JOIN labels l USING (doc_id)")
def confidence_tier(t: Tables):
    kind = F.when(F.col("source") == "src0", "official").when(F.col("source") == "src1", "registry").when(F.col("source") == "src2", "media").otherwise("other")
    joined = t.documents.join(t.labels, "doc_id", "left")
    return joined.select("doc_id", K.confidence_tier(kind, F.coalesce(F.col("quality") == 1, F.lit(False))).alias("tier"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 AND n_chars > 1000 THEN 'accepted' WHEN quality = 1 THEN 'review' ELSE 'rejected' END AS status, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 AND n_chars > 1000 THEN 'long' WHEN quality = 1 THEN 'short' ELSE 'quality' END AS reason FROM documents JOIN labels USING (doc_id)")
def candidate_policy(t: Tables):
    good = F.col("quality") == 1
    status, why = K.decided([(F.col("toxic") == 1, "rejected", "toxic"), (good & (F.col("n_chars") > 1000), "accepted", "long"), (good, "review", "short")], ("rejected", "quality"))
    return t.documents.join(t.labels, "doc_id").select("doc_id", status.alias("status"), why.alias("reason"))


@query("""
SELECT p_partkey, round_even(least(1.0, CASE WHEN p_size < 10 THEN 0.45 WHEN p_size < 20 THEN 0.25 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 0.25 ELSE 0 END
  + CASE WHEN p_retailprice >= 1000 THEN 0.30 WHEN p_retailprice >= 950 THEN 0.22 ELSE 0.10 END + CASE WHEN p_type = 'PROMO' THEN 0.05 ELSE 0 END + CASE WHEN p_brand = 'Brand#2' THEN 0.20 ELSE 0 END)::DOUBLE, 3) AS score FROM part
""")
def entry_score(t: Tables):
    near = F.when(F.col("p_retailprice") >= 1000, 95).when(F.col("p_retailprice") >= 950, 80).otherwise(60)
    domain = F.when(F.col("p_size") < 10, "same").when(F.col("p_size") < 20, "related").otherwise("other")
    return t.part.select("p_partkey", K.entry_score(domain, F.col("p_name").contains("red"), near, F.col("p_type") == "PROMO", F.col("p_brand") == "Brand#2").alias("score"))
