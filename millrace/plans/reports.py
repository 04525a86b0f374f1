"""Reports: coverage, dashboard, grouped counts, merges of children, censuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators import relational as R
from ..operators import windows as W
from .base import Tables, query

AS_OF, HOURS = "2024-01-30 00:00:00", 24
RATE = "CASE WHEN {1} <> 0 THEN floor({0} * 10000.0 / {1} + 0.5) / 10000 END"


def snapshots(t: Tables):
    """Events as snapshots of users: purchases and signups succeed, signups are empty, errors fail, the rest is partial."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind.isin("purchase", "signup"), "succeeded").otherwise("partial")
    return t.events.select(F.col("user_id").alias("entry"), F.col("ts").cast("timestamp_ntz").alias("at"), F.col("ts").cast("timestamp_ntz").alias("created"), F.col("event_id").alias("id"), status.alias("status"), (status == "succeeded").alias("succeeded"), kind.isin("purchase", "signup").alias("complete"), (kind == "signup").alias("empty"))


_REPORT = f"""
WITH q AS (
  SELECT user_id, event_type = 'signup' AS empty FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
    WHERE event_type IN ('purchase', 'signup') AND ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL {HOURS} HOUR AND TIMESTAMP '{AS_OF}') WHERE rn = 1
), a AS (SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type <> 'error')),
c AS (
  SELECT (SELECT count(DISTINCT user_id) FROM events) AS target, count(*) AS active, count(q.empty) AS enumerated, count(*) FILTER (WHERE q.empty) AS confirmed_empty, count(q.empty) AS entries_enumerated
  FROM a LEFT JOIN q USING (user_id))
SELECT *, {RATE.format("active", "target")} AS entry_rate, {RATE.format("enumerated", "active")} AS enumeration_rate, {RATE.format("enumerated", "target")} AS refresh_rate, {RATE.format("confirmed_empty", "enumerated")} AS empty_rate FROM c
"""


@query(_REPORT)
def coverage_report(t: Tables):
    entries = t.events.groupBy(F.col("user_id").alias("owner")).agg(F.bool_or(F.col("event_type") != "error").alias("active")).withColumn("entry", F.col("owner"))
    return C.coverage_report(entries, snapshots(t), AS_OF, HOURS)


@query(f"""
WITH s AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('purchase', 'signup') THEN 'succeeded' ELSE 'partial' END AS status, event_type = 'signup' AS empty FROM events),
l AS (SELECT user_id, arg_max(status, (ts, event_id)) AS status, arg_max(empty, (ts, event_id)) AS empty, max(ts) FILTER (WHERE status = 'succeeded') AS ok FROM s GROUP BY user_id),
d AS (SELECT user_id AS entry, CASE WHEN status <> 'succeeded' AND ok IS NULL THEN 'never_listed' WHEN status <> 'succeeded' THEN 'failed' WHEN empty THEN 'confirmed_empty' ELSE 'listed' END AS status,
  coalesce(ok >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR, false) AS fresh, status AS last FROM l)
SELECT entry, status, fresh, CASE WHEN last <> 'succeeded' THEN last WHEN NOT fresh THEN 'stale' END AS reason FROM d
""")
def entity_coverage_status(t: Tables):
    return C.entity_status(snapshots(t), "entry", AS_OF)


@query("""
SELECT 'orders' AS metric, 'all' AS name, count(*) AS n FROM orders
UNION ALL SELECT 'orders', 'priced', count(*) FILTER (WHERE o_totalprice > 0) FROM orders
UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'events', 'all', count(*) FROM events
""")
def overview_stats(t: Tables):
    one = t.orders.agg(F.count("*").alias("all"), F.count_if(F.col("o_totalprice") > 0).alias("priced"))
    long = one.select(F.lit("orders").alias("metric"), F.explode(F.array(F.struct(F.lit("all").alias("name"), F.col("all").alias("n")), F.struct(F.lit("priced").alias("name"), F.col("priced").alias("n")))).alias("x")).select("metric", "x.name", "x.n")
    grouped = [R.counts_by(t.orders, "o_orderstatus").select(F.lit("status").alias("metric"), "name", "n"), R.counts_by(t.customer, "c_mktsegment").select(F.lit("segment").alias("metric"), "name", "n")]
    total = t.events.groupBy("event_type").count().agg(F.sum("count").alias("n")).select(F.lit("events").alias("metric"), F.lit("all").alias("name"), "n")
    return long.unionByName(grouped[0]).unionByName(grouped[1]).unionByName(total)


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, name LIMIT 12")
def top_groups(t: Tables):
    return R.top_counts(t.part, "p_name", 12)


@query("""
SELECT coalesce(nullif(c_mktsegment, ''), 'unknown') AS name, count(*) AS n, floor(100.0 * count(*) / (SELECT count(*) FROM customer) + 0.5)::BIGINT AS pct FROM customer GROUP BY 1
""")
def share_by_segment(t: Tables):
    counts = R.counts_by(t.customer, "c_mktsegment")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("name", "n", R.percent(F.col("n"), F.col("total")).alias("pct"))


@query("""
SELECT s.event_type, coalesce(n, 0) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) s(event_type)
LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) c USING (event_type)
""")
def zero_filled_status(t: Tables):
    return R.zero_filled(t.events, "event_type", ["click", "error", "purchase", "refund", "signup", "view"])


@query("SELECT count(DISTINCT user_id) AS discovered, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS accepted, count(DISTINCT CASE WHEN value > 20 THEN user_id END) AS large FROM events")
def distinct_set_sizes(t: Tables):
    return t.events.agg(F.countDistinct("user_id").alias("discovered"), F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("accepted"), F.countDistinct(F.when(F.col("value") > 20, F.col("user_id"))).alias("large"))


@query("""
SELECT l_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen, strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen, bool_or(l_linestatus = 'O') AS is_active, max(l_discount) AS confidence,
  array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS fields FROM lineitem GROUP BY l_orderkey
""")
def merge_minmax_any(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_seen"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_seen"), F.bool_or(F.col("l_linestatus") == "O").alias("is_active"),
        F.max("l_discount").alias("confidence"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("fields"),
    )


@query("SELECT p_name, arg_min(p_brand, (p_size, p_partkey)) AS p_brand, arg_min(p_partkey, (p_size, p_partkey)) AS p_partkey FROM part GROUP BY p_name")
def representative_min_by(t: Tables):
    return R.best_per_key(t.part, ["p_name"], ["p_size", "p_partkey", "p_brand"]).select("p_name", "p_brand", "p_partkey")


@query("SELECT lower(replace(p_name, ' ', '')) AS norm, min(p_name) AS display, count(*) AS n FROM part GROUP BY 1")
def display_name_min(t: Tables):
    return t.part.groupBy(F.lower(F.regexp_replace("p_name", r"\s", "")).alias("norm")).agg(F.min("p_name").alias("display"), F.count("*").alias("n"))


@query("SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS latest, max(o_orderkey) FILTER (WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)) AS o_orderkey FROM orders")
def latest_published(t: Tables):
    top = t.orders.select("o_orderdate", "o_orderkey").distinct().orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1)
    return top.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("latest"), "o_orderkey")


@query("""
SELECT user_id, sum(value_n)::BIGINT AS pages, sum(cnt)::BIGINT AS jobs, min(first_error) AS first_error FROM (
  SELECT user_id, event_type, count(*) AS cnt, count(*) FILTER (WHERE value > 10) AS value_n, min(CASE WHEN event_type = 'error' THEN event_id END) AS first_error FROM events GROUP BY 1, 2) GROUP BY user_id
""")
def provider_stats_fold(t: Tables):
    parts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("cnt"), F.count_if(F.col("value") > 10).alias("value_n"), F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("first_error"))
    return parts.groupBy("user_id").agg(F.sum("value_n").alias("pages"), F.sum("cnt").alias("jobs"), F.min("first_error").alias("first_error"))


@query("SELECT p_name AS key, count(DISTINCT p_brand) AS owners FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def shared_key_having(t: Tables):
    return R.shared_keys(t.part.select(F.col("p_name").alias("key"), "p_brand"), "key", "p_brand")


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables):
    return R.duplicate_keys(t.orders.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "o_custkey", "day")


@query("""
SELECT o.o_orderkey, coalesce(string_agg(l.l_linenumber || ':' || l.l_partkey, ',' ORDER BY l.l_linenumber, l.l_partkey), '') AS items, count(l.l_partkey) AS n
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey
""")
def attach_children(t: Tables):
    nested = R.attach(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", "items", ["l_linenumber", "l_partkey"], ["l_quantity"])
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return nested.select("o_orderkey", text.alias("items"), F.size("items").cast("long").alias("n"))


@query("""
SELECT d.doc_id, d.source, coalesce(l.n, 0) AS labels, coalesce(l.good, false) AS good, d.lang FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n, bool_or(quality = 1) AS good FROM labels GROUP BY 1) l USING (doc_id)
""")
def detail_rows(t: Tables):
    own = t.labels.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("quality") == 1).alias("good"))
    return t.documents.select("doc_id", "source", "lang").join(own, "doc_id", "left").select("doc_id", "source", F.coalesce("n", F.lit(0)).alias("labels"), F.coalesce("good", F.lit(False)).alias("good"), "lang")


@query(f"""
WITH c AS (SELECT count(*) AS documents, count(DISTINCT source) AS sources, (SELECT count(*) FROM labels) AS labelled, (SELECT count(*) FROM labels WHERE toxic = 1) AS severe,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)) AS kept FROM documents d)
SELECT *, {RATE.format("labelled", "documents")} AS label_rate, {RATE.format("kept", "documents")} AS kept_rate FROM c
""")
def census(t: Tables):
    severe = t.labels.where("toxic = 1").select("doc_id").distinct()
    kept = t.documents.join(severe, "doc_id", "left_anti").agg(F.count("*").alias("kept"))
    labels = t.labels.agg(F.count("*").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("severe"))
    one = t.documents.agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources")).crossJoin(labels).crossJoin(kept)
    return one.select("documents", "sources", "labelled", "severe", "kept", R.rate(F.col("labelled"), F.col("documents")).alias("label_rate"), R.rate(F.col("kept"), F.col("documents")).alias("kept_rate"))


@query(f"""
WITH c AS (SELECT d.source AS round, count(*) AS observed, count(l.doc_id) AS sampled, count(*) FILTER (WHERE l.quality = 1) AS accepted, count(*) FILTER (WHERE l.toxic = 1) AS severe
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
SELECT *, {RATE.format("accepted", "sampled")} AS accepted_rate, severe > 0 AS paused FROM c
""")
def round_census(t: Tables):
    joined = t.documents.select("doc_id", F.col("source").alias("round")).join(t.labels.withColumn("sampled", F.lit(1)), "doc_id", "left")
    counts = joined.groupBy("round").agg(F.count("*").alias("observed"), F.count("sampled").alias("sampled"), F.count_if(F.col("quality") == 1).alias("accepted"), F.count_if(F.col("toxic") == 1).alias("severe"))
    return counts.select("*", R.rate(F.col("accepted"), F.col("sampled")).alias("accepted_rate"), (F.col("severe") > 0).alias("paused"))


@query("SELECT sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS fingerprint, count(*) AS n FROM labels WHERE quality = 1")
def membership_hash(t: Tables):
    return R.fingerprint(t.labels.where("quality = 1"), "doc_id")


@query("SELECT DISTINCT d.source, d.lang FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def paused_strata(t: Tables):
    return t.documents.join(t.labels.where("toxic = 1"), "doc_id").select("source", "lang").distinct()


@query("""
SELECT user_id, event_type AS latest, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def latest_per_entity(t: Tables):
    return W.latest(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("latest"), "event_id")


@query("""
WITH r(round, started) AS (VALUES (1, TIMESTAMP '2024-01-05 00:00:00'), (2, TIMESTAMP '2024-01-15 12:00:00'), (3, TIMESTAMP '2024-01-29 00:00:00'))
SELECT round::BIGINT AS round, user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events JOIN r ON ts < started GROUP BY 1, 2
""")
def latest_before_round(t: Tables):
    rounds = t.spark.sql("SELECT * FROM VALUES (1L, timestamp_ntz'2024-01-05 00:00:00'), (2L, timestamp_ntz'2024-01-15 12:00:00'), (3L, timestamp_ntz'2024-01-29 00:00:00') AS r(round, started)")
    rows = t.events.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    return W.latest_before(rows, rounds, "user_id", "ts", "event_id", "started").select("round", "user_id", "event_id")
