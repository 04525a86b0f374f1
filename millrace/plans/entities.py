"""Search, filters, joins, set operations and lifecycle."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators import relational as R
from ..operators import search_index as I
from ..operators import windows as W
from ..staging import shared_folder
from .base import Tables, also, query

_LAST = "TIMESTAMP '2024-01-30 00:00:00'"
LAST = "2024-01-30 00:00:00"


@query("""
WITH b AS (SELECT p_partkey, lower(p_name) AS n, lower(p_type) AS a FROM part)
SELECT p_partkey, tier FROM (SELECT p_partkey, CASE WHEN n = 'promo' THEN 0 WHEN a = 'promo' THEN 1 WHEN starts_with(n, 'promo') THEN 2 WHEN starts_with(a, 'promo') THEN 3 WHEN contains(n, 'promo') THEN 4 WHEN contains(a, 'promo') THEN 5 ELSE 6 END AS tier FROM b) WHERE tier < 6
UNION ALL
SELECT p_partkey, tier FROM (SELECT p_partkey, CASE WHEN n = 'red' THEN 0 WHEN a = 'red' THEN 1 WHEN starts_with(n, 'red') THEN 2 WHEN starts_with(a, 'red') THEN 3 WHEN contains(n, 'red') THEN 4 WHEN contains(a, 'red') THEN 5 ELSE 6 END AS tier FROM b) WHERE tier < 6
""")
def search_tiered(t: Tables):
    names = t.part.select("p_partkey", F.lower("p_name").alias("name"))
    aliases = t.part.select(F.col("p_partkey").alias("owner"), F.lower("p_type").alias("alias"))
    parts = [R.search(names, aliases, q, "p_partkey", "name", "owner", "alias").select("p_partkey", "tier") for q in ("promo", "red")]
    return parts[0].unionByName(parts[1])


@query("""
WITH q(q) AS (VALUES ('ring'), ('red g'), ('large'), ('ed'), ('zzz')), e AS (SELECT p_partkey, lower(p_name) AS name, lower(p_type) AS alias, q FROM part, q)
SELECT p_partkey, q, CASE WHEN name = q THEN 0 WHEN alias = q THEN 1 WHEN starts_with(name, q) THEN 2 WHEN starts_with(alias, q) THEN 3 WHEN contains(name, q) THEN 4 ELSE 5 END AS tier
FROM e WHERE contains(name, q) OR contains(alias, q)
""")
def search_indexed(t: Tables):
    """Several searches over indexes of names and aliases that are written first."""
    spark, folder = t.spark, f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
    I.build(t.part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name")), f"{folder}/names", 8)
    I.build(t.part.select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("name")), f"{folder}/aliases", 8)
    found = [I.search(spark, f"{folder}/names", f"{folder}/aliases", q, 8).select(F.col("id").alias("p_partkey"), F.lit(q).alias("q"), "tier") for q in ("ring", "red g", "large", "ed", "zzz")]
    return reduce(DataFrame.unionByName, found)


@query("""
SELECT p_partkey, p_name, tier FROM (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'ring' THEN 0 WHEN starts_with(lower(p_name), 'ring') THEN 2 WHEN contains(lower(p_name), 'ring') THEN 4 ELSE 6 END AS tier FROM part)
WHERE tier < 6 ORDER BY tier, p_name, p_partkey LIMIT 20 OFFSET 20
""")
def search_page(t: Tables):
    names = t.part.select("p_partkey", "p_name", F.lower("p_name").alias("name"))
    none = t.part.select(F.col("p_partkey").alias("owner"), F.lit("").alias("alias"))
    return R.page(R.search(names, none, "ring", "p_partkey", "name", "owner", "alias"), [F.col("tier"), F.col("p_name"), F.col("p_partkey")], 2, 20).select("p_partkey", "p_name", "tier")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def search_filters(t: Tables):
    return R.matching(t.customer, c_mktsegment="BUILDING", c_nationkey=3, c_name=None).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def search_sort_name(t: Tables):
    return R.page(t.customer.select("c_custkey", "c_name"), [F.col("c_name"), F.col("c_custkey")], 3, 20)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def search_sort_recent(t: Tables):
    return R.page(t.orders, [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""
WITH r AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal > 5000 THEN (row_number() OVER (PARTITION BY c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey)) END AS rank FROM customer)
SELECT c_custkey, rank FROM r ORDER BY rank IS NULL, coalesce(rank, 10000), c_name, c_custkey LIMIT 50 OFFSET 50
""")
def default_rank_order(t: Tables):
    ranked = W.dense_positions(t.customer.where("c_acctbal > 5000").select((-F.col("c_acctbal")).alias("v"), "c_custkey"), ["v", "c_custkey"], "place").select("c_custkey", (F.col("place") + 1).alias("rank"))
    joined = t.customer.join(ranked, "c_custkey", "left")
    return R.page(joined, [F.col("rank").isNull(), F.coalesce("rank", F.lit(10000)), F.col("c_name"), F.col("c_custkey")], 2, 50).select("c_custkey", "rank")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS posted FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O') ORDER BY posted DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 20
""")
def jobs_page_nulls_last(t: Tables):
    posted = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    live = R.having_active(t.orders, t.lineitem, "o_orderkey", "l_orderkey", F.col("l_linestatus") == "O").select("o_orderkey", posted.alias("posted"))
    return R.page(live, [F.desc_nulls_last("posted"), F.col("o_orderkey")], 2, 20)


@query("SELECT least(5, count(*)) AS shown, count(*) AS total FROM orders WHERE o_orderstatus = 'P'")
def capped_total(t: Tables):
    return t.orders.where("o_orderstatus = 'P'").agg(F.least(F.lit(5), F.count("*")).cast("long").alias("shown"), F.count("*").alias("total"))


@query("SELECT o_custkey, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'O') GROUP BY 1")
def active_children_count(t: Tables):
    live = R.having_active(t.orders, t.lineitem, "o_orderkey", "l_orderkey", F.col("l_linestatus") == "O")
    return live.groupBy("o_custkey").agg(F.count("*").alias("n"))


_EARLY = "(lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderpriority) LIKE '%low%' OR o_orderstatus = 'P')"


@query(f"""
SELECT o_custkey, count(*) FILTER (WHERE {_EARLY} AND o_orderpriority NOT LIKE '%LOW%' AND o_orderstatus = 'F') AS campus,
  count(*) FILTER (WHERE {_EARLY} AND NOT (o_orderpriority NOT LIKE '%LOW%' AND o_orderstatus = 'F')) AS internship,
  count(*) FILTER (WHERE {_EARLY} AND (o_orderpriority LIKE '%LOW%' OR o_orderstatus = 'P')) AS internship_ranked,
  count(*) FILTER (WHERE {_EARLY} AND NOT (o_orderpriority LIKE '%LOW%' OR o_orderstatus = 'P')) AS campus_ranked FROM orders GROUP BY o_custkey
""")
def early_bucket_counts(t: Tables):
    """Two classifiers that differ: one calls a row campus only if its type says so, the other unless a word or type says internship."""
    early = R.any_keyword(F.col("o_orderpriority"), ["urgent", "low"]) | (F.col("o_orderstatus") == "P")
    word = F.col("o_orderpriority").contains("LOW")
    campus, ranked = ~word & (F.col("o_orderstatus") == "F"), word | (F.col("o_orderstatus") == "P")
    return R.bucket_counts(t.orders, "o_custkey", campus=early & campus, internship=early & ~campus, internship_ranked=early & ranked, campus_ranked=early & ~ranked)


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'O')")
def semi_active(t: Tables):
    return R.having_active(t.customer, t.orders, "c_custkey", "o_custkey", F.col("o_orderstatus") == "O").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND event_type = 'error')")
def anti_enqueue(t: Tables):
    return R.excluding(t.customer.select("c_custkey"), (t.orders.where("o_orderstatus = 'P'"), "o_custkey"), (t.events.where("event_type = 'error'"), "user_id"), key="c_custkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_check(t: Tables):
    return R.orphans(t.documents.select("doc_id"), t.labels, "doc_id", "doc_id")


@query("SELECT DISTINCT a.p_name AS name, a.p_brand AS brand, b.p_brand AS other FROM (SELECT DISTINCT p_name, p_brand FROM part) a JOIN (SELECT DISTINCT p_name, p_brand FROM part) b ON a.p_name = b.p_name AND a.p_brand <> b.p_brand")
def cross_name_conflict(t: Tables):
    a = t.part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).distinct()
    b = a.select(F.col("name").alias("n"), F.col("brand").alias("other"))
    return a.join(b, (a["name"] == b["n"]) & (a["brand"] != b["other"])).select("name", "brand", "other").distinct()


also("all_name_conflicts", "cross_name_conflict")


@query("SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word IN ('red', 'ring', 'gear')")
def unnest_join(t: Tables):
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).where(F.col("word").isin("red", "ring", "gear"))


@query("SELECT norm, owner FROM (SELECT lower(p_name) AS norm, p_partkey AS owner FROM part UNION SELECT lower(p_brand) AS norm, p_partkey AS owner FROM part)")
def union_distinct_owners(t: Tables):
    names = t.part.select(F.lower("p_name").alias("norm"), F.col("p_partkey").alias("owner"))
    return names.unionByName(t.part.select(F.lower("p_brand").alias("norm"), F.col("p_partkey").alias("owner"))).distinct()


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def set_difference(t: Tables):
    return R.missing_from(t.events.where("event_type = 'view'"), t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("user_id")), "user_id")


@query("SELECT text_hash, doc_id FROM (SELECT md5(text) AS text_hash, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def first_wins_dedupe(t: Tables):
    return R.first_wins(t.documents.select(F.md5(F.col("text").cast("binary")).alias("text_hash"), "doc_id"), ["text_hash"], [F.col("doc_id")])


@query("SELECT source, lang, max(doc_id) AS doc_id, min(doc_id) AS place FROM documents GROUP BY 1, 2")
def last_wins_dedupe(t: Tables):
    rows = t.documents.select("source", "lang", "doc_id", F.col("doc_id").alias("at"))
    return R.last_wins(rows, ["source", "lang"], "doc_id", ["at"])


@query("SELECT o_custkey AS id, 'orders' AS origin FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT DISTINCT user_id, 'events' FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)")
def suppressed_union(t: Tables):
    stored = t.orders.select(F.col("o_custkey").alias("id")).distinct().withColumn("origin", F.lit("orders"))
    return R.with_suppressed(stored, t.events.select(F.col("user_id").alias("id")).distinct().withColumn("origin", F.lit("events")), ["id"])


also("all_suppressed_union", "suppressed_union")


@query("SELECT s_suppkey, s_acctbal >= 0 AND s_nationkey < 20 AS valid, CASE WHEN s_acctbal < 0 AND s_nationkey >= 20 THEN 'balance,nation' WHEN s_acctbal < 0 THEN 'balance' WHEN s_nationkey >= 20 THEN 'nation' ELSE '' END AS reasons FROM supplier")
def validation_split(t: Tables):
    good, bad = R.validated(t.supplier, {"balance": F.col("s_acctbal") >= 0, "nation": F.col("s_nationkey") < 20})
    one = good.select("s_suppkey", F.lit(True).alias("valid"), F.lit("").alias("reasons"))
    return one.unionByName(bad.select("s_suppkey", F.lit(False).alias("valid"), F.array_join("reasons", ",").alias("reasons")))


@query(f"""
WITH s AS (SELECT user_id, max(ts) AS seen, bool_or(event_type = 'purchase' AND value > 50) AS managed FROM events WHERE ts < TIMESTAMP '2024-01-29 20:00:00' GROUP BY 1)
SELECT user_id, managed, NOT managed AND seen < {_LAST} - INTERVAL 1 DAY AS expired, seen IS NULL OR seen < {_LAST} - INTERVAL 24 HOUR AS stale FROM s
""")
def expiry_flags(t: Tables):
    seen = t.events.where(F.col("ts") < F.lit("2024-01-29 20:00:00").cast("timestamp_ntz")).groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("seen"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("managed"))
    now = F.lit(LAST).cast("timestamp_ntz")
    return seen.select("user_id", "managed", L.expired(F.lit(True), F.col("managed"), F.col("seen"), now, 1).alias("expired"), L.stale(F.col("seen"), now - F.expr("INTERVAL '24' HOUR")).alias("stale"))


@query(f"SELECT c_custkey FROM customer c LEFT JOIN (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1) e ON c.c_custkey = e.user_id WHERE seen IS NULL OR seen < {_LAST} - INTERVAL 24 HOUR")
def stale_entities(t: Tables):
    seen = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("seen"))
    return t.customer.select("c_custkey").join(seen, "c_custkey", "left").where(L.stale(F.col("seen"), F.lit(LAST).cast("timestamp_ntz") - F.expr("INTERVAL '24' HOUR"))).select("c_custkey")


_ISLANDS = "SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM"


@query(f"""
WITH e AS (SELECT user_id, ts, event_id, event_type = 'error' AS hit FROM events), i AS ({_ISLANDS} e),
s AS (SELECT user_id, event_id, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM i)
SELECT user_id, max(streak) AS longest, min(CASE WHEN streak >= 3 THEN event_id END) AS stopped_at FROM s GROUP BY user_id
""")
def rate_limit_streaks(t: Tables):
    runs = W.streaks(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return runs.groupBy("user_id").agg(F.max("streak").alias("longest"), F.min(F.when(F.col("streak") >= 3, F.col("event_id"))).alias("stopped_at"))


@query(f"""
WITH e AS (SELECT user_id, ts, event_id, event_type <> 'purchase' AS hit FROM events WHERE event_type IN ('purchase', 'signup', 'click')), i AS ({_ISLANDS} e)
SELECT event_id, user_id, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w::BIGINT AS missing, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w < 2 AS active FROM i WINDOW w AS (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def absence_lifecycle(t: Tables):
    """Purchases are sightings, signups and clicks complete snapshots without the source; all else says nothing."""
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    done = L.absence(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type").isin("signup", "click"))
    return done.select("event_id", "user_id", "missing", "active")


@query("""
SELECT event_id, coalesce(ts > max(ts) OVER (PARTITION BY user_id ORDER BY (event_id * 7919) % 1009, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS applied FROM events
""")
def late_snapshots(t: Tables):
    rows = t.events.select("event_id", "user_id", "ts", F.struct((F.col("event_id") * 7919 % 1009).alias("a"), "event_id").alias("arrival"))
    return L.in_order(rows, "user_id", "ts").select("event_id", "applied")


@query("SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'applied' WHEN event_type = first_value(event_type) OVER w THEN 'replayed' ELSE 'conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id, props ORDER BY ts, event_id)")
def command_replay(t: Tables):
    return L.replays(t.events, ["user_id", "props"], "event_type", ["ts", "event_id"]).select("event_id", "outcome")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def last_state(t: Tables):
    return W.last_state(t.events, "user_id", "event_type", ["ts", "event_id"])


@query("SELECT user_id, event_id FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def bounded_probes(t: Tables):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("n", n).where("n <= 3").select("user_id", "event_id")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def coalesced_requests(t: Tables):
    return t.events.where(F.col("event_type").isin("view", "click")).groupBy("user_id").agg(F.min("event_id").alias("event_id"))
