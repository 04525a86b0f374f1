"""Discovery rounds, their audits and the requests behind them, over whole tables in the roles of those records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import rounds as R
from .base import Tables, query


def _source(number: str) -> Column:
    return F.concat(F.lit("src_"), F.col(number).cast("string"))


def _entries(t: Tables):
    roles = F.when(F.col("s_nationkey") % 5 == 0, F.array(F.lit("entry_discovery_fallback"))).when(F.col("s_nationkey") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("candidate_pool"), F.lit("entry_discovery_fallback")))
    number = F.when(F.col("s_suppkey") % 11 == 1, F.col("s_suppkey") - 1).otherwise(F.col("s_suppkey"))
    name = F.when(F.col("s_suppkey") % 13 == 0, F.concat(F.lit("Src-"), number.cast("string"))).otherwise(F.concat(F.lit("src_"), number.cast("string")))
    return t.supplier.select("s_suppkey", name.alias("id"), F.concat(F.lit("https://s"), F.col("s_nationkey").cast("string"), F.lit(".example/")).alias("base_url"), roles.alias("roles"), (F.col("s_acctbal") / 8000).alias("requests_per_second"), (F.col("s_suppkey") % 17 != 0).alias("enabled"))


_ENTRIES = """e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN 'Src-' ELSE 'src_' END || CASE WHEN s_suppkey % 11 = 1 THEN s_suppkey - 1 ELSE s_suppkey END AS id, 'https://s' || s_nationkey || '.example/' AS base_url,
  CASE WHEN s_nationkey % 5 = 0 THEN ['entry_discovery_fallback'] WHEN s_nationkey % 7 = 0 THEN [] ELSE ['candidate_pool', 'entry_discovery_fallback'] END AS roles, s_acctbal / 8000 AS rate, s_suppkey % 17 <> 0 AS enabled FROM supplier),
checked AS (SELECT *, CASE WHEN NOT regexp_matches(id, '^[a-z][a-z0-9_]{2,49}$') THEN 'invalid_id' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'repeated_id' WHEN len(roles) = 0 THEN 'no_role'
  WHEN rate <= 0 OR rate > 1 THEN 'invalid_rate' WHEN NOT enabled THEN 'disabled' ELSE '' END AS error FROM e)"""


@query(f"WITH {_ENTRIES} SELECT s_suppkey, id, error FROM checked")
def registry_errors(t: Tables):
    return R.registry_errors(_entries(t)).select("s_suppkey", "id", F.coalesce("error", F.lit("")).alias("error"))


@query(f"""WITH {_ENTRIES}, good AS (SELECT * FROM checked WHERE error = '')
SELECT o_orderkey, coalesce(list_contains(g.roles, 'candidate_pool') AND g.base_url = 'https://s' || (o_custkey % 5) || '.example/', FALSE) AS registered FROM orders LEFT JOIN good g ON g.id = 'src_' || (o_orderkey % 100)""")
def registered_sources(t: Tables):
    registry = R.registry_errors(_entries(t)).where("error IS NULL")
    url = F.concat(F.lit("https://s"), (F.col("o_custkey") % 5).cast("string"), F.lit(".example/"))
    candidates = t.orders.withColumn("n", F.col("o_orderkey") % 100).select("o_orderkey", _source("n").alias("source_id"), url.alias("source_url"))
    return R.registered(candidates, registry).select("o_orderkey", "registered")


_OUTCOME_SQL = """
WITH r AS (
  SELECT o_orderkey AS round_id, o_orderkey % 5 = 0 AS is_stored, sha256(o_orderpriority) AS manifest_version, CASE WHEN o_custkey % 29 = 0 THEN '-' ELSE '' END || 'round-' || (o_custkey // 2) AS name,
    CASE WHEN o_orderkey % 31 = 1 THEN 'x' ELSE sha256(o_orderstatus) END AS config, sha256('m') AS model, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 5 END AS predecessor_id, o_orderdate AS started_at,
    CASE WHEN o_orderkey % 4 = 0 THEN sha256('f' || o_custkey % 2) END AS membership, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 37 <> 2 THEN o_custkey % 43 END AS members FROM orders
), stored AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY manifest_version, name ORDER BY round_id) AS n FROM r WHERE is_stored) WHERE n = 1),
j AS (
  SELECT p.*, s.round_id AS s_id, s.membership AS s_membership, s.members AS s_members, s.config AS s_config, s.model AS s_model, s.predecessor_id AS s_pred, s.started_at AS s_at,
    CASE WHEN NOT regexp_matches(p.name, '^[a-z0-9][a-z0-9_-]{2,99}$') THEN 'invalid_name' WHEN NOT regexp_matches(p.config, '^[0-9a-f]{64}$') THEN 'invalid_fingerprint'
      WHEN (p.membership IS NULL) <> (p.members IS NULL) THEN 'incomplete_membership' WHEN p.membership IS NOT NULL AND p.members < 1 THEN 'invalid_membership'
      WHEN p.manifest_version = sha256('5-LOW') THEN 'unknown_manifest' END AS unsound,
    CASE WHEN p.predecessor_id IS NOT NULL AND b.manifest_version IS DISTINCT FROM p.manifest_version THEN 'unknown_predecessor' WHEN p.started_at <= b.started_at THEN 'not_after_predecessor' END AS headless
  FROM r p LEFT JOIN stored s ON p.manifest_version = s.manifest_version AND p.name = s.name LEFT JOIN stored b ON b.round_id = p.predecessor_id WHERE NOT p.is_stored
), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manifest_version, name ORDER BY started_at, round_id) AS n FROM j WHERE unsound IS NULL AND headless IS NULL AND s_id IS NULL) WHERE n = 1)
SELECT j.round_id, coalesce(j.unsound, CASE
  WHEN j.s_id IS NOT NULL THEN CASE WHEN j.membership IS DISTINCT FROM j.s_membership OR j.members IS DISTINCT FROM j.s_members THEN 'conflicting_membership'
    WHEN j.config IS DISTINCT FROM j.s_config OR j.predecessor_id IS DISTINCT FROM j.s_pred OR j.started_at IS DISTINCT FROM j.s_at THEN 'conflicting_round' ELSE 'replayed' END
  WHEN f.round_id = j.round_id THEN 'created'
  WHEN (j.started_at, j.round_id) > (f.started_at, f.round_id) THEN CASE WHEN j.membership IS DISTINCT FROM f.membership OR j.members IS DISTINCT FROM f.members THEN 'conflicting_membership'
    WHEN j.config IS DISTINCT FROM f.config OR j.predecessor_id IS DISTINCT FROM f.predecessor_id OR j.started_at IS DISTINCT FROM f.started_at THEN 'conflicting_round' ELSE 'replayed' END END, j.headless) AS outcome
FROM j LEFT JOIN firsts f ON j.manifest_version = f.manifest_version AND j.name = f.name
"""


@query(_OUTCOME_SQL)
def round_outcomes(t: Tables):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    sha = lambda c: F.sha2(c, 256)
    fourth = key % 4 == 0
    rounds = t.orders.select(
        key.alias("round_id"), sha(F.col("o_orderpriority")).alias("manifest_version"),
        F.concat(F.when(cust % 29 == 0, "-").otherwise(""), F.lit("round-"), F.floor(cust / 2).cast("string")).alias("name"),
        F.when(key % 31 == 1, "x").otherwise(sha(F.col("o_orderstatus"))).alias("config_fingerprint"), sha(F.lit("m")).alias("model_fingerprint"),
        F.when(key % 3 == 0, cust * 5).alias("predecessor_id"), F.col("o_orderdate").alias("started_at"),
        F.when(fourth, sha(F.concat(F.lit("f"), (cust % 2).cast("string")))).alias("membership_fingerprint"), F.when(fourth & (key % 37 != 2), cust % 43).alias("member_count"),
    )
    there = rounds.where("round_id % 5 = 0")
    stored = there.groupBy("manifest_version", "name").agg(F.min_by(F.struct(*there.columns), "round_id").alias("r")).select("r.*")
    manifests = t.orders.where("o_orderpriority <> '5-LOW'").select(sha(F.col("o_orderpriority")).alias("version"))
    return R.round_outcomes(rounds.where("round_id % 5 <> 0"), stored, manifests).select("round_id", "outcome")


@query("""
WITH o AS (SELECT o_custkey % 3 AS round_id, o_orderkey AS observation_id, CASE WHEN o_orderstatus = 'P' THEN 'blocked' ELSE 'accepted' END AS status, 'src_' || o_custkey % 4 AS source_id, 'ats' AS platform, o_orderdate AS observed_at FROM orders),
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN l_partkey % 50 = 0 THEN 3 ELSE 0 END + o.round_id AS round_id, l_orderkey AS observation_id, CASE WHEN l_suppkey % 19 = 0 THEN 'S' WHEN l_suppkey % 17 = 0 THEN 'src_9' ELSE o.source_id END AS source_id,
  CASE WHEN l_linenumber = 7 THEN '9' ELSE 'ats' END AS platform, l_shipdate AS selected_at FROM lineitem JOIN o ON l_orderkey = o.observation_id),
j AS (SELECT s.*, s.observation_id % 4 = 0 AS held, o.source_id AS st_source, o.observed_at + INTERVAL 30 DAY AS st_at, CASE WHEN NOT regexp_matches(s.source_id, '^[a-z][a-z0-9_]{2,49}$') THEN 'invalid_source' WHEN NOT regexp_matches(s.platform, '^[a-z][a-z0-9_]{0,49}$') THEN 'invalid_platform'
  WHEN o.observed_at IS NULL THEN 'unknown_observation' WHEN o.status <> 'accepted' THEN 'not_accepted' WHEN s.source_id <> o.source_id OR s.platform <> o.platform THEN 'conflicting_stratum' WHEN s.selected_at < o.observed_at THEN 'before_observation' END AS broken
  FROM s LEFT JOIN o USING (round_id, observation_id)),
f AS (SELECT round_id, observation_id, min(selected_at) AS first_at FROM j WHERE broken IS NULL AND NOT held GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, coalesce(broken, CASE WHEN held AND source_id = st_source AND selected_at = st_at THEN 'replayed' WHEN NOT held AND selected_at = first_at THEN 'recorded' ELSE 'conflicting_selection' END) AS outcome FROM j LEFT JOIN f USING (round_id, observation_id)
""")
def audit_outcomes(t: Tables):
    seen = t.orders.select(
        (F.col("o_custkey") % 3).alias("round_id"), F.col("o_orderkey").alias("observation_id"), F.when(F.col("o_orderstatus") == "P", "blocked").otherwise("accepted").alias("status"),
        F.concat(F.lit("src_"), (F.col("o_custkey") % 4).cast("string")).alias("source_id"), F.lit("ats").alias("platform"), F.col("o_orderdate").alias("observed_at"),
    )
    own = seen.select("observation_id", F.col("round_id").alias("own_round"), F.col("source_id").alias("own_source"))
    source = F.when(F.col("l_suppkey") % 19 == 0, "S").when(F.col("l_suppkey") % 17 == 0, "src_9").otherwise(F.col("own_source"))
    chosen = t.lineitem.withColumn("observation_id", F.col("l_orderkey")).join(own, "observation_id").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "observation_id", (F.when(F.col("l_partkey") % 50 == 0, 3).otherwise(0) + F.col("own_round")).alias("round_id"),
        source.alias("source_id"), F.when(F.col("l_linenumber") == 7, "9").otherwise("ats").alias("platform"), F.col("l_shipdate").alias("selected_at"),
    )
    stored = seen.where("observation_id % 4 = 0").select("round_id", "observation_id", "source_id", "platform", (F.col("observed_at") + F.expr("INTERVAL 30 DAYS")).alias("selected_at"))
    return R.audit_outcomes(chosen, seen, stored).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "outcome")


@query("""
WITH s AS (SELECT l_orderkey AS sample_id, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS finding_id, l_shipdate AS audited_at FROM lineitem WHERE l_returnflag = 'R'),
j AS (SELECT o_custkey AS observation_id, finding_id, audited_at FROM s JOIN orders ON sample_id = o_orderkey),
h AS (SELECT observation_id, max(finding_id) AS held FROM j WHERE observation_id % 4 = 0 GROUP BY 1), f AS (SELECT DISTINCT ON (observation_id) observation_id, finding_id AS first FROM j ORDER BY observation_id, audited_at, finding_id)
SELECT observation_id, finding_id, audited_at AS quarantined_at, CASE WHEN held = finding_id THEN 'kept' WHEN held IS NOT NULL THEN 'conflicting' WHEN first = finding_id THEN 'added' ELSE 'conflicting' END AS outcome FROM j LEFT JOIN h USING (observation_id) JOIN f USING (observation_id)
""")
def quarantines(t: Tables):
    number = F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    findings = t.lineitem.select(F.col("l_orderkey").alias("sample_id"), number.alias("finding_id"), (F.col("l_returnflag") == "R").alias("severe"), F.col("l_shipdate").alias("audited_at"))
    samples = t.orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("observation_id"))
    stored = findings.where("severe").join(samples, "sample_id").where("observation_id % 4 = 0").groupBy("observation_id").agg(F.max("finding_id").alias("finding_id"))
    return R.quarantines(findings, samples, stored)


@query("""
SELECT l_partkey, l_suppkey, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ',') AS covered_fields, max(l_discount) AS confidence FROM lineitem GROUP BY l_partkey, l_suppkey
""")
def covered_fields(t: Tables):
    keys, rows = ["l_partkey", "l_suppkey"], t.lineitem.select("l_partkey", "l_suppkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("field"), F.col("l_discount").alias("confidence"))
    stored = rows.where("l_linenumber <= 2").groupBy(*keys).agg(F.collect_set("field").alias("covered_fields"), F.max("confidence").alias("confidence"))
    return R.covered_fields(stored, rows.where("l_linenumber > 2"), keys).withColumn("covered_fields", F.array_join("covered_fields", ","))


@query("""
WITH r AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'queued' WHEN 'signup' THEN 'running' ELSE 'succeeded' END AS status FROM events)
SELECT DISTINCT ON (user_id) user_id, event_id, ts, status FROM r WHERE status IN ('queued', 'running') ORDER BY user_id, ts, event_id
""")
def active_requests(t: Tables):
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "queued").when(kind == "signup", "running").otherwise("succeeded")
    return R.active_requests(t.events.select("user_id", "event_id", "ts", status.alias("status")), ["user_id"], ["ts", "event_id"])


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey")
def companies_in_order(t: Tables):
    return t.supplier.select("s_suppkey", "s_name").orderBy("s_name", "s_suppkey")
