"""What to collect and what collected documents say."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import cards as C
from ..functions import jobs as J
from ..operators import robots as R
from ..operators import signals as S
from ..sources import readers, workbook
from ..staging import shared_folder
from .base import Tables, query


@query("""
WITH f(field, term, also) AS (VALUES ('licence', 'license', 'licensed'), ('insult', 'worthless', 'pathetic'), ('secret', 'password=', 'token = '))
SELECT d.source, f.field, min(d.doc_id) AS doc_id FROM documents d JOIN f ON contains(lower(d.text), f.term) OR contains(lower(d.text), f.also) GROUP BY 1, 2
""")
def profile_hints(t: Tables):
    return S.hints(t.documents, "source", "doc_id", "text", {"licence": ["license", "licensed"], "insult": ["worthless", "pathetic"], "secret": ["password=", "token = "]})


@query("SELECT s_suppkey, category FROM supplier, (VALUES ('view'), ('click'), ('purchase'), ('refund')) c(category) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = s_suppkey AND e.event_type = c.category AND e.value > 50)")
def collection_grid(t: Tables):
    done = t.events.where("value > 50").select(F.col("user_id").alias("s_suppkey"), F.col("event_type").alias("category"))
    return S.still_to_collect(t.supplier, "s_suppkey", ["view", "click", "purchase", "refund"], done)


@query("""
WITH v AS (SELECT p_partkey, unnest(list_distinct([p_name, split_part(p_name, ' ', 2)])) AS variant FROM part)
SELECT p_partkey, 'site:' || site || ' "' || variant || '"' AS query FROM v, (VALUES ('a.example'), ('b.example')) s(site)
""")
def site_queries(t: Tables):
    names = t.part.select("p_partkey", F.array("p_name", F.substring_index("p_name", " ", -1)).alias("v"))
    return S.site_queries(names, "p_partkey", "v", ["a.example", "b.example"]).select("p_partkey", "query")


@query("""
SELECT user_id, CASE event_type WHEN 'view' THEN 'patent' ELSE 'bid' END AS key, strftime(ts, '%Y-%m-%d') AS day, event_type || '-' || (event_id % 3) AS label FROM events
WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-20' AND (event_type = 'view' OR event_id % 2 = 0) GROUP BY ALL
""")
def vendor_signals(t: Tables):
    """Events wrapped as vendor responses: views in items, clicks in a nested source with a winner."""
    e = t.events.where("event_type IN ('view', 'click')")
    item = F.struct(F.concat_ws("-", "event_type", (F.col("event_id") % 3).cast("string")).alias("name"), F.date_format(F.add_months("ts", 0), "yyyy-MM-dd").alias("date"), F.when(F.col("event_id") % 2 == 0, "own").otherwise("other").alias("winner"))
    payload = F.when(F.col("event_type") == "view", F.to_json(F.struct(F.array(item).alias("items")))).otherwise(F.to_json(F.struct(F.create_map(F.lit("cert"), F.struct(F.array(item).alias("items"))).alias("sources"))))
    body = F.concat(F.lit('{"responses":[{"tool":"'), F.col("event_type"), F.lit('","payload":'), payload, F.lit("}]}"))
    aliases = t.events.select(F.col("user_id").alias("owner"), F.lit("own").alias("alias")).distinct()
    found = S.signals(S.items(e.select("user_id", body.alias("body"))), "user_id", F.lit("2027-01-20").cast("date"), {"view": "patent", "click": "bid"}, aliases)
    return found.select("user_id", "key", F.date_format("date", "yyyy-MM-dd").alias("day"), "label")


#: What stands for a list item and its salary on the pages of each platform.
CARD_MARKUP = {
    "feishu": '<li class="job-item">', "moka": '<li class="position-item" data-position-id="7">', "liepin": '<li class="job-list-item"><b class="job-salary">20-30K·14薪</b>',
    "lagou": '<li class="con_list_item"><b class="money">15k-25k</b><i class="add">上海', "bytedance": '<li class="x-job-item wide"><span class="a-location">北京', "generic": '<li class="position">',
}


def platform_pages(t: Tables):
    """Every page as each platform would mark up its list: items that aren't closed (i, span, b, p) among them."""
    item = F.create_map(*[F.lit(x) for pair in CARD_MARKUP.items() for x in pair])
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: a file of one row group would be one task
    pages = t.pages.select("page_id", "html").repartition(tasks, "page_id").select("page_id", "html", F.explode(F.array(*map(F.lit, CARD_MARKUP))).alias("platform"))
    marked = F.replace(F.replace("html", F.lit("<li>"), item[F.col("platform")]), F.lit('<a href="/'), F.lit('<a class="position_link" href="/jobs/job/'))
    return pages.select("page_id", "platform", marked.alias("html"))


@query()
def platform_jobs(t: Tables):
    return C.candidates(platform_pages(t), "html", "platform").withColumn("attributes", F.to_json("attributes"))


@query()
def platform_list_status(t: Tables):
    return C.list_status(platform_pages(t), "html", "platform")


@query()
def html_job_rows(t: Tables):
    return t.pages.select("page_id", F.explode(J.job_rows("html")).alias("j")).select("page_id", "j.*")


@query("SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%low%' THEN 'x' END AS city, CASE WHEN o_orderstatus = 'F' THEN 'campus' ELSE 'internship' END AS shown, CASE WHEN o_orderstatus = 'P' THEN 'internship' ELSE 'campus' END AS ranked FROM orders")
def job_types(t: Tables):
    kind = F.when(F.col("o_orderstatus") == "F", "campus").when(F.col("o_orderstatus") == "P", "internship").otherwise("experienced")
    text = F.lower("o_orderpriority")
    return t.orders.select("o_orderkey", F.when(J.city(text, ["low", "urgent"]) == "low", "x").alias("city"), J.public_type(text, kind).alias("shown"), J.ranking_type(text, kind).alias("ranked"))


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#32')")
def workbook_rows(t: Tables):
    """Parts written as workbooks and read back by brand."""
    spark = t.spark
    workbook.register(spark)
    path = f"{shared_folder(spark)}/workbooks-{uuid.uuid4().hex}"
    parts = t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    parts.write.format("workbook").option("sheet", "parts").option("header", 2).mode("append").save(path)
    back = spark.read.format("workbook").option("sheet", "parts").option("header", 2).schema(parts.schema).load(path)
    return back.where(F.col("p_brand").isin("Brand#11", "Brand#23", "Brand#32"))


@query("""
WITH c AS (SELECT p_partkey, p_name AS name, p_brand, p_size AS score, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS normalized_name, sha256(p_type || p_partkey) AS identity_hash FROM part
  WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#32') AND p_size % 7 <> 0)
SELECT * EXCLUDE (p_brand) FROM c QUALIFY row_number() OVER (PARTITION BY normalized_name ORDER BY p_partkey) = 1
""")
def eligible_candidates(t: Tables):
    """Of parts with an eligible brand and a score, the first of each name."""
    score = F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    rows = t.part.select("p_partkey", F.col("p_name").alias("name"), "p_brand", F.concat("p_type", F.col("p_partkey").cast("string")).alias("code"), score.alias("score"))
    return readers.eligible(rows, "p_partkey", "name", "p_brand", ["Brand#11", "Brand#23", "Brand#32"], "code", "score")


#: Robots files, given to a site by the length of its host.
ROBOTS = [
    ("ok", "User-agent: bad\nDisallow: /\n\nUser-agent: *\nDisallow: /en/  # a comment\nAllow: /en/1\nDisallow: /*?page=\nAllow: /*%23top$\nallow:\n"),
    ("ok", "User-agent: millrace\nUser-agent: other\nDisallow: /de\nAllow: /de/*5$\nDisallow: /fr/*&ref=x$\nSitemap: x\nCrawl-delay: 3\nUser-agent: *\nDisallow: /"),
    ("ok", "Disallow: /\nUser-agent: *\n\nDisallow: /es\nUser-agent: *\nDisallow:\nDisallow: /fr\n"),
    ("absent", None),
    ("failed", None),
]
#: The same rules by hand: site's number, line, whether it allows, pattern, and length of the path.
_FIRST = """(0, 4, false, '^/en/', 0), (0, 5, true, '^/en/1', 0), (0, 6, false, '^/[*][?]page=', 0), (0, 7, true, '^/[*]#top[$]', 0),
  (1, 2, false, '^/de', 0), (1, 3, true, '^/de/[*]5[$]', 0), (1, 4, false, '^/fr/[*]&ref=x[$]', 0), (2, 5, true, '^', 0), (2, 6, false, '^/fr', 0)"""
_LONGEST = """(0, 4, false, '^/en/', 4), (0, 5, true, '^/en/1', 5), (0, 6, false, '^/.*[?]page=', 8), (0, 7, true, '^/.*#top$', 7),
  (1, 2, false, '^/de', 3), (1, 3, true, '^/de/.*5$', 7), (1, 4, false, '^/fr/.*&ref=x$', 12), (2, 3, false, '^/es', 3), (2, 5, true, '^', 0), (2, 6, false, '^/fr', 3)"""


def _robots_sql(rules: str, best: str) -> str:
    return f"""
WITH p AS (SELECT page_id, lower(split_part(url, '://', 1)) || '://' || lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)) || CASE WHEN url LIKE 'https%' THEN ':443' ELSE ':80' END AS site,
    regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS rest FROM pages),
u AS (SELECT page_id, site, length(site) % 5 AS kind, CASE WHEN rest = '' THEN '/' WHEN rest[1] IN ('?', '#') THEN '/' || rest ELSE rest END AS path FROM p),
r(kind, pos, allow, pattern, weight) AS (VALUES {rules}),
m AS (SELECT page_id, arg_max(pos, {best}) AS pos, arg_max(allow, {best}) AS allow FROM u JOIN r ON u.kind = r.kind AND regexp_matches(u.path, r.pattern) GROUP BY page_id)
SELECT u.page_id, u.site, m.pos AS rule, CASE WHEN kind = 4 THEN false ELSE coalesce(m.allow, true) END AS may_fetch FROM u LEFT JOIN m ON u.page_id = m.page_id
"""


def _robots(t: Tables, order: str):
    pages = t.pages.select("page_id", "url")
    sites = pages.select(R.origin(F.col("url")).alias("site")).distinct()
    kind = F.length("site") % len(ROBOTS)
    status, text = (F.element_at(F.array(*[F.lit(x[k]) for x in ROBOTS]), (kind + 1).cast("int")) for k in (0, 1))
    files = sites.select("site", status.alias("status"), text.alias("text"))
    return R.verdicts(pages, "url", files, "Millrace/1.0", order).drop("url")


@query(_robots_sql(_LONGEST, "1000000 * weight + 100000 * allow::INT - pos"))
def robots_longest_match(t: Tables):
    return _robots(t, "longest")


@query(_robots_sql(_FIRST, "-pos"))
def robots_first_match(t: Tables):
    return _robots(t, "first")
