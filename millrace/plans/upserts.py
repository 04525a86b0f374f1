"""Merge rules: halves of a table as what is stored and what comes in."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import merge as M
from ..sources import sinks, versions
from ..sources.versions import VersionedTable
from ..staging import shared_folder
from .base import Tables, query


@query("""
WITH s AS (SELECT doc_id // 3 AS k, max(n_chars) AS n_chars, arg_max(source, (n_chars, doc_id)) AS source FROM documents GROUP BY 1),
i AS (SELECT doc_id // 2 AS k, max(n_chars) AS n_chars, arg_max(source, (n_chars, doc_id)) AS source FROM documents GROUP BY 1)
SELECT coalesce(s.k, i.k) AS k, CASE WHEN i.k IS NOT NULL AND (s.k IS NULL OR i.n_chars >= s.n_chars) THEN i.source ELSE s.source END AS source, greatest(s.n_chars, i.n_chars) AS n_chars FROM s FULL JOIN i ON s.k = i.k
""")
def merge_documents(t: Tables):
    def half(n: int):
        rows = t.documents.select(F.expr(f"doc_id div {n}").alias("k"), "n_chars", "doc_id", "source")
        return rows.groupBy("k").agg(F.max("n_chars").alias("n_chars"), F.max_by("source", F.struct("n_chars", "doc_id")).alias("source"))

    return M.newest(half(3), half(2), ["k"], "n_chars").select("k", "source", "n_chars")


@query("""
WITH s AS (SELECT doc_id // 2 AS k, max(n_chars) AS n_chars, arg_max(source, (n_chars, doc_id)) AS source FROM documents WHERE doc_id % 3 <> 1 GROUP BY 1),
i AS (SELECT doc_id // 2 AS k, max(n_chars) AS n_chars, arg_max(source, (n_chars, doc_id)) AS source FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
SELECT coalesce(s.k, i.k) AS k, CASE WHEN i.k IS NOT NULL AND (s.k IS NULL OR i.n_chars >= s.n_chars) THEN i.source ELSE s.source END AS source, greatest(s.n_chars, i.n_chars) AS n_chars FROM s FULL JOIN i ON s.k = i.k
""")
def merge_all_documents(t: Tables):
    """Every document is stored, comes in, or both; a pair of documents is one entity."""

    def side(other: int):
        rows = t.documents.where(F.col("doc_id") % 3 != other).select(F.expr("doc_id div 2").alias("k"), "n_chars", "doc_id", "source")
        return rows.groupBy("k").agg(F.max("n_chars").alias("n_chars"), F.max_by("source", F.struct("n_chars", "doc_id")).alias("source"))

    return M.newest(side(1), side(0), ["k"], "n_chars").select("k", "source", "n_chars")


@query("""
WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS title, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS kind, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders),
i AS (SELECT o_orderkey - 1500 AS k, o_orderstatus AS title, o_orderpriority AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders)
SELECT coalesce(s.k, i.k) AS k, CASE WHEN i.k IS NOT NULL THEN i.title ELSE s.title END AS title, coalesce(s.kind, i.kind) AS kind, coalesce(i.price, s.price) AS price, least(s.posted, i.posted) AS posted,
  CASE WHEN length(i.kind) > length(s.kind) OR s.kind IS NULL THEN coalesce(i.kind, s.kind) ELSE s.kind END AS description, s.k IS NULL AS created FROM s FULL JOIN i ON s.k = i.k
""")
def merge_jobs(t: Tables):
    o = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted"))
    k = F.col("o_orderkey")
    stored = o.select(k.alias("k"), "title", F.when(k % 5 > 0, F.col("kind")).alias("kind"), "price", "posted").withColumn("description", F.col("kind"))
    incoming = o.select((k - 1500).alias("k"), "title", "kind", F.when(k % 2 == 0, F.col("price")).alias("price"), "posted").withColumn("description", F.col("kind"))
    done = M.merged(stored, incoming, ["k"], {"title": "overwrite", "kind": "keep", "price": "fill", "posted": "earliest", "description": "longer"})
    return done.withColumn("created", F.col("change") == "created").drop("change")


@query("""
WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS title, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS kind, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders WHERE o_orderkey % 3 <> 1),
i AS (SELECT o_orderkey - 1 AS k, o_orderstatus AS title, o_orderpriority AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders WHERE o_orderkey % 3 <> 0)
SELECT coalesce(s.k, i.k) AS k, CASE WHEN i.k IS NOT NULL THEN i.title ELSE s.title END AS title, coalesce(s.kind, i.kind) AS kind, coalesce(i.price, s.price) AS price, least(s.posted, i.posted) AS posted,
  CASE WHEN length(i.kind) > length(s.kind) OR s.kind IS NULL THEN coalesce(i.kind, s.kind) ELSE s.kind END AS description, s.k IS NULL AS created FROM s FULL JOIN i ON s.k = i.k
""")
def merge_all_jobs(t: Tables):
    """Every order is stored, comes in (under the key before its own), or both."""
    o = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted"))
    k = F.col("o_orderkey")
    stored = o.where(k % 3 != 1).select(k.alias("k"), "title", F.when(k % 5 > 0, F.col("kind")).alias("kind"), "price", "posted").withColumn("description", F.col("kind"))
    incoming = o.where(k % 3 != 0).select((k - 1).alias("k"), "title", "kind", F.when(k % 2 == 0, F.col("price")).alias("price"), "posted").withColumn("description", F.col("kind"))
    done = M.merged(stored, incoming, ["k"], {"title": "overwrite", "kind": "keep", "price": "fill", "posted": "earliest", "description": "longer"})
    return done.withColumn("created", F.col("change") == "created").drop("change")


@query("""
WITH s AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey < 1000), i AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END AS c_name FROM customer WHERE c_custkey >= 500)
SELECT coalesce(s.c_custkey, i.c_custkey) AS c_custkey, coalesce(i.c_name, s.c_name) AS c_name, CASE WHEN s.c_custkey IS NULL THEN 'created' WHEN i.c_custkey IS NULL OR i.c_name = s.c_name THEN 'unchanged' ELSE 'updated' END AS change FROM s FULL JOIN i ON s.c_custkey = i.c_custkey
""")
def seed_upsert(t: Tables):
    c, key = t.customer.select("c_custkey", "c_name"), F.col("c_custkey")
    incoming = c.where(key >= 500).withColumn("c_name", F.when(key % 2 == 0, F.col("c_name")).otherwise(F.upper("c_name")))
    return M.merged(c.where(key < 1000), incoming, ["c_custkey"], {"c_name": "overwrite"})


@query("SELECT i.doc_id, CASE WHEN s.doc_id IS NULL THEN 'create' WHEN s.source = i.source THEN 'replay' ELSE 'conflict' END AS outcome FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE source END AS source FROM documents) i LEFT JOIN (SELECT doc_id, source FROM documents WHERE doc_id < 500) s USING (doc_id)")
def fact_import(t: Tables):
    rows = t.documents.select("doc_id", "source")
    incoming = rows.withColumn("source", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("source")))
    return M.classified(incoming, rows.where("doc_id < 500"), "doc_id", "source").select("doc_id", "outcome")


@query("""
WITH o AS (SELECT p_name AS name, min(p_partkey) AS owner FROM part WHERE p_size < 5 GROUP BY 1), w AS (SELECT DISTINCT p_name AS name, p_partkey % 7 AS owner FROM part WHERE p_size = 7)
SELECT w.name, w.owner, CASE WHEN o.name IS NULL THEN 'add' ELSE 'conflict' END AS outcome FROM w LEFT JOIN o USING (name) WHERE o.owner IS NULL OR o.owner <> w.owner
""")
def alias_conflicts(t: Tables):
    owned = t.part.where("p_size < 5").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("owner"))
    wanted = t.part.where("p_size = 7").select(F.col("p_name").alias("name"), (F.col("p_partkey") % 7).alias("owner")).distinct()
    add, conflict = M.owner_conflicts(wanted, owned, "name", "owner")
    return add.select("name", "owner", F.lit("add").alias("outcome")).unionByName(conflict.select("name", "owner", F.lit("conflict").alias("outcome")))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_primary FROM orders")
def primary_entry(t: Tables):
    return M.with_primary(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "is_primary")


@query("""
WITH c AS (SELECT p_name AS name, min(p_partkey) AS id FROM part WHERE p_size < 2 GROUP BY 1), a AS (SELECT p_name AS name, max(p_partkey) AS id FROM part WHERE p_size > 45 GROUP BY 1)
SELECT p.p_partkey, coalesce(c.id, a.id) AS id FROM part p LEFT JOIN c ON p.p_name = c.name LEFT JOIN a ON p.p_name = a.name
""")
def name_to_id(t: Tables):
    canonical = t.part.where("p_size < 2").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    aliases = t.part.where("p_size > 45").groupBy(F.col("p_name").alias("name")).agg(F.max("p_partkey").alias("id"))
    return M.resolved(t.part.select("p_partkey", "p_name"), "p_name", canonical, aliases).select("p_partkey", "id")


@query("""
WITH m AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS row FROM supplier WHERE s_suppkey < 50),
x AS (SELECT s_nationkey, s_suppkey FROM supplier WHERE s_suppkey >= 30 AND s_suppkey >= 50)
SELECT s_nationkey, s_suppkey, row FROM m UNION ALL
SELECT x.s_nationkey, x.s_suppkey, coalesce((SELECT max(row) FROM m WHERE m.s_nationkey = x.s_nationkey), 0) + row_number() OVER (PARTITION BY x.s_nationkey ORDER BY x.s_suppkey) FROM x
""")
def appended_members(t: Tables):
    rows = t.supplier.select("s_nationkey", "s_suppkey")
    members = rows.where("s_suppkey < 50").withColumn("row", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("long"))
    return M.appended_members(members, rows.where("s_suppkey >= 30"), "s_nationkey", "row", "s_suppkey")


@query("SELECT text_hash, count(DISTINCT source) AS sources, count(DISTINCT source) >= 2 AS verified FROM (SELECT md5(text) AS text_hash, source FROM documents) GROUP BY 1")
def verified_facts(t: Tables):
    return M.verified_by_sources(t.documents.select(F.md5(F.col("text").cast("binary")).alias("text_hash"), "source"), ["text_hash"], "source")


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def streamed_upserts(t: Tables):
    """Events as a stream of files, upserted by user into a versioned table, one micro-batch a file; one batch comes twice."""
    spark, folder = t.spark, f"{shared_folder(t.spark)}/upserts-{uuid.uuid4().hex}"
    events = t.events.select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    events.repartition(4, "event_id").write.parquet(f"{folder}/in")
    schema = "user_id long, event_id long, event_type string, value double, at long"
    table = VersionedTable(spark, f"{folder}/table", schema, ["user_id"], 8)
    newest = versions.newest(["user_id"], ["at", "event_id"])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream.writeStream.foreachBatch(versions.upserting(table, newest)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    table.upsert(events.limit(1), 0, newest)  # a replay of batch 0 changes nothing, whatever it brings
    return table.read().select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("""SELECT o_orderstatus, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS price FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0""")
def replaced_partitions(t: Tables):
    """Orders by status, of which the rows of one status are replaced; the other partitions stay as they are."""
    path = f"{shared_folder(t.spark)}/partitions-{uuid.uuid4().hex}"
    orders = t.orders.select("o_orderstatus", "o_orderkey", F.col("o_totalprice").alias("price"))
    sinks.replace_partitions(orders, path, "o_orderstatus")
    sinks.replace_partitions(orders.where("o_orderstatus = 'P' AND o_orderkey % 2 = 0").withColumn("price", -F.col("price")), path, "o_orderstatus")
    return t.spark.read.schema("o_orderkey long, price double, o_orderstatus string").parquet(path)
