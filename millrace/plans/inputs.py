"""Readers of nested and strict JSON, mappings, canonical digests and reports, over texts that Spark makes of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import rounds as N
from ..sources import readers, sinks
from ..staging import shared_folder
from .base import Tables, query


@query("""
WITH p AS (SELECT p_brand AS canonical_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position, p_name AS title, p_type AS job_type, p_size AS low, p_partkey FROM part)
SELECT canonical_name, position::INTEGER AS position, title, job_type, low, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS n_sources FROM p
""")
def seed_jobs(t: Tables):
    """Brands as seed files of version 1 with their parts as jobs, written and read back."""
    path = f"{shared_folder(t.spark)}/seed-{uuid.uuid4().hex}"
    source = F.struct(F.lit("shop").alias("provider"), F.col("p_partkey").cast("string").alias("source_raw_id"), F.lit(True).alias("is_active"))
    job = F.struct("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("job_type"), F.col("p_size").alias("salary_min_monthly"), F.when(F.col("p_partkey") % 3 == 0, F.array()).otherwise(F.array(source)).alias("sources"))
    brands = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    company = F.struct(F.col("p_brand").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), "jobs")
    files = brands.select("p_brand", F.to_json(F.struct(F.lit(1).alias("version"), F.array(company).alias("companies"))).alias("value"))
    files.write.partitionBy("p_brand").text(path)  # a file is one brand's document
    read = readers.seed(t.spark, path)
    n = read["sources"].groupBy("canonical_name", "position").agg(F.count("*").cast("int").alias("n_sources"))
    jobs = read["jobs"].select("canonical_name", "position", "title", "job_type", F.col("salary_min_monthly").alias("low"))
    return jobs.join(n, ["canonical_name", "position"], "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))


@query("""
WITH x AS (SELECT c_name AS name, 'https://s' || (c_custkey // 2 * (c_custkey % 5)) || '.example' AS site FROM customer UNION ALL SELECT c_name, 'https://again.example/' || c_custkey FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT 'nobody ' || s_suppkey, 'https://n.example/' || s_suppkey FROM supplier),
k AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN (SELECT min(c_name) FROM customer) ELSE c_name END AS name, c_custkey AS id FROM customer),
o AS (SELECT name, count(*) AS owners, min(id) AS id FROM k GROUP BY name),
j AS (SELECT x.name, x.site, o.id, o.owners, count(*) OVER (PARTITION BY x.name) AS n, count(*) OVER (PARTITION BY x.site) AS s FROM x LEFT JOIN o ON x.name = o.name),
r AS (SELECT *, CASE WHEN n > 1 THEN 'name_twice' WHEN s > 1 THEN 'site_twice' WHEN owners IS NULL THEN 'unknown_name' WHEN owners > 1 THEN 'ambiguous_name' END AS reason FROM j)
SELECT name, site, CASE WHEN reason IS NULL THEN id END AS id, reason FROM r
""")
def site_mapping(t: Tables):
    """Names of customers mapped to sites: names and sites that occur twice, names that are nobody's or several companies'."""
    k = F.col("c_custkey")
    site = F.concat(F.lit("https://s"), (F.expr("c_custkey div 2") * (k % 5)).cast("string"), F.lit(".example"))
    pairs = t.customer.select(F.col("c_name").alias("name"), site.alias("site"))
    pairs = pairs.unionByName(t.customer.where(k % 7 == 0).select(F.col("c_name").alias("name"), F.concat(F.lit("https://again.example/"), k.cast("string")).alias("site")))
    pairs = pairs.unionByName(t.supplier.select(F.concat(F.lit("nobody "), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("https://n.example/"), F.col("s_suppkey").cast("string")).alias("site")))
    least = t.customer.agg(F.min("c_name").alias("least"))
    companies = t.customer.join(F.broadcast(least), F.lit(True)).select(F.when(k % 11 == 0, F.col("least")).otherwise(F.col("c_name")).alias("name"), k.alias("id"))
    good, bad = readers.site_mapping(pairs, companies)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.withColumn("id", F.lit(None).cast("long")).select("name", "site", "id", "reason"))


def _bodies(t: Tables):
    """A customer's orders as a list of jobs; some lists are boxed, some jobs lack a name or a url."""
    k = F.col("o_orderkey")
    url = F.when(k % 9 != 0, F.concat(F.lit("https://j.example/"), k.cast("string")))
    name = F.when(k % 10 != 0, F.col("o_orderpriority")).otherwise(F.lit("  "))
    own = t.orders.select("o_custkey", "o_orderkey", F.struct(k.cast("string").alias("id"), name.alias("name"), url.alias("url")).alias("job"))
    lists = own.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "job"))), lambda x: x["job"]).alias("jobs"))
    boxed = F.to_json(F.struct(F.col("jobs").alias("items"), (F.col("o_custkey") % 4 == 1).alias("has_more")))
    return lists.select("o_custkey", F.when(F.col("o_custkey") % 2 == 0, F.to_json("jobs")).otherwise(boxed).alias("body"))


_EXTERNAL = """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, o_orderpriority, o_orderkey % 9 = 0 OR o_orderkey % 10 = 0 AS bad FROM orders)"""


@query(f"{_EXTERNAL} SELECT o_custkey, o_custkey % 4 <> 1 AS complete, count(*) AS n, count(*) FILTER (WHERE bad) AS rejected, count(*) FILTER (WHERE bad) > 0.2 * count(*) AS failed FROM o GROUP BY o_custkey")
def external_verdicts(t: Tables):
    return readers.external_jobs(_bodies(t))[1]


@query(f"{_EXTERNAL} SELECT o_custkey, position::INTEGER AS position, o_orderkey::VARCHAR AS id, o_orderpriority AS name, 'https://j.example/' || o_orderkey AS url FROM o WHERE NOT bad")
def external_rows(t: Tables):
    return readers.external_jobs(_bodies(t))[0].select("o_custkey", "position", "id", "name", "url")


@query("""
SELECT o_custkey, CASE WHEN o_custkey % 6 IN (0, 4) AND NOT (o_custkey % 6 = 4 AND count(*) > 1) THEN count(*)::INTEGER END AS n,
  CASE o_custkey % 6 WHEN 1 THEN 'no_list' WHEN 2 THEN 'unknown_field' WHEN 3 THEN 'wrong_type' WHEN 5 THEN 'too_large' WHEN 4 THEN CASE WHEN count(*) > 1 THEN 'key_twice' END END AS reason
FROM orders GROUP BY o_custkey
""")
def strict_lists(t: Tables):
    """A customer's orders as a strict list, broken in one of five ways for five customers in six."""
    kind = F.col("o_custkey") % 6
    key = F.when(kind == 4, F.lit(1).cast("long")).otherwise(F.col("o_orderkey"))
    item = F.when(kind == 2, F.to_json(F.struct(key.alias("id"), F.col("o_orderstatus").alias("state"), F.lit(1).alias("more"))))
    item = item.when(kind == 3, F.to_json(F.struct(F.lit("x").alias("id"), F.col("o_orderstatus").alias("state")))).otherwise(F.to_json(F.struct(key.alias("id"), F.col("o_orderstatus").alias("state"))))
    lists = t.orders.groupBy("o_custkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("body"))
    body = F.when(kind == 1, F.concat(F.lit('{"items":'), "body", F.lit("}"))).when(kind == 5, F.rpad("body", 70_000, " ")).otherwise(F.col("body"))
    return readers.strict_list(lists.select("o_custkey", body.alias("body")), "body", "id long, state string", "id", 60_000)[1]


_CANONICAL = """'{"brand":"' || p_brand || '","name":' || CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE '"' || p_name || '"' END || ',"size":' || p_size || '}'"""


@query(f"SELECT p_partkey, {_CANONICAL} AS payload, sha256({_CANONICAL}) AS identity FROM part")
def canonical_identities(t: Tables):
    p = t.part.select("p_partkey", F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("name"), F.col("p_brand").alias("brand"))
    return p.select("p_partkey", sinks.canonical_json("size", "name", "brand").alias("payload"), sinks.identity("size", "name", "brand").alias("identity"))


@query("""
WITH a AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS aliases, min(p_size) AS size, max(p_retailprice)::DECIMAL(12, 2) AS price FROM part GROUP BY p_brand)
SELECT p_brand, sha256('{"aliases":[' || array_to_string(list_transform(aliases, lambda x: '"' || x || '"'), ',') || '],"brand":"' || p_brand || '","price":"' || price || '","size":' || size || '}') AS identity FROM a
""")
def identity_payloads(t: Tables):
    """Digests of nested payloads: sorted aliases, amounts as plain decimals."""
    own = t.part.groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_set("p_type")).alias("aliases"), F.min("p_size").alias("size"), F.max("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"))
    return own.select(F.col("brand").alias("p_brand"), sinks.identity("brand", "aliases", "size", "price").alias("identity"))


@query("""SELECT '{"n":' || count(*) || ',"status":"' || o_orderstatus || '"}' AS line FROM orders GROUP BY o_orderstatus""")
def report_lines(t: Tables):
    """A report, written whole and read back."""
    path = f"{shared_folder(t.spark)}/report-{uuid.uuid4().hex}"
    sinks.report(t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query("""
WITH s AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49),
a AS (SELECT p_brand, count(*) FILTER (WHERE l_returnflag = 'R') > 0.335 * count(*) AS paused FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 GROUP BY p_brand),
f AS (SELECT sha256(string_agg(p_partkey::VARCHAR, chr(10) ORDER BY p_partkey::VARCHAR)) AS fingerprint FROM part),
c AS (SELECT p_brand, count(*) AS members, count(l_partkey) AS observed FROM part LEFT JOIN s ON p_partkey = l_partkey GROUP BY p_brand)
SELECT c.p_brand, members, observed, coalesce(paused, false) AS paused, CASE WHEN coalesce(paused, false) THEN 0 ELSE members - observed END AS pending, fingerprint FROM c LEFT JOIN a ON c.p_brand = a.p_brand, f
""")
def evidence_round(t: Tables):
    """Parts still to be observed, by brand, where audits of the brand's lines don't pause it."""
    members = t.part.select("p_partkey", "p_brand")
    observed = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    audits = t.lineitem.where("l_linenumber = 1").join(members, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_returnflag")
    return N.evidence_round(members, observed, audits, "p_brand", "p_partkey", F.col("l_returnflag") == "R", "0.335")
