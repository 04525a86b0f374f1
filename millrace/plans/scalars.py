"""Scalar functions over pages, documents, events and literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import html as H
from ..functions import similarity as S
from .base import Tables, query

_HOST = "lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1))"
_NORM = f"CASE WHEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) IN ('http', 'https') AND {_HOST} <> '' THEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || {_HOST} || CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#:@]+:([0-9]+)', 1) IN ('', '80', '443') THEN '' ELSE ':' || regexp_extract(url, '^[A-Za-z]+://[^/?#:@]+:([0-9]+)', 1) END || regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^#]*)', 1) END"


@query(f"SELECT page_id, {_NORM} AS url FROM pages")
def normalize_urls(t: Tables):
    return t.pages.select("page_id", C.normalized_url(F.col("url")).alias("url"))


@query(f"SELECT page_id, regexp_replace({_NORM}, '\\?.*$', '') AS identity FROM pages")
def url_identity(t: Tables):
    return t.pages.select("page_id", C.identity_url(F.col("url")).alias("identity"))


@query(f"""
WITH u AS (SELECT page_id, {_NORM} AS url FROM pages), s AS (SELECT page_id, regexp_replace(split_part(url, '?', 1), '/$', '') AS base,
  array_to_string(list_filter(string_split(regexp_extract(url, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')), '&') AS query FROM u)
SELECT page_id, base || CASE WHEN query = '' THEN '' ELSE '?' || query END AS entry FROM s
""")
def entry_urls(t: Tables):
    return t.pages.select("page_id", C.entry_url(F.col("url")).alias("entry"))


@query(f"SELECT page_id, array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.') AS root FROM pages")
def root_domains(t: Tables):
    return t.pages.select("page_id", C.root_domain(F.col("url")).alias("root"))


@query(f"SELECT page_id, CASE WHEN {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org' THEN 'org' WHEN {_HOST} LIKE '%.example.net' THEN 'self_hosted' ELSE 'unknown' END AS platform, {_HOST} LIKE '%.%' AS public FROM pages")
def platform_class(t: Tables):
    return t.pages.select("page_id", C.platform(F.col("url"), {"example.org": "org"}, F.lit("example.net")).alias("platform"), C.statically_public(F.col("url")).alias("public"))


@query("SELECT o_orderkey, strftime(o_orderdate - INTERVAL 36 MONTH, '%Y-%m-%d') AS three_years, strftime(try_strptime(left(strftime(o_orderdate, '%Y-%m-%d') || 'T00', 10), '%Y-%m-%d'), '%Y-%m-%d') AS day, year(o_orderdate)::INT AS year, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM orders")
def iso_dates(t: Tables):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00"))
    day = C.iso_date(text)
    return t.orders.select("o_orderkey", F.date_format(C.years_before(F.to_date("o_orderdate"), 3), "yyyy-MM-dd").alias("three_years"), F.date_format(day, "yyyy-MM-dd").alias("day"), F.year("o_orderdate").alias("year"), C.utc_text(F.col("o_orderdate")).alias("utc"))


@query("SELECT p_partkey, CASE WHEN p_size <= 25 THEN p_size * 1000 END AS low, CASE WHEN p_size <= 25 THEN 25000 END AS high, CASE WHEN p_size <= 25 THEN 13::SMALLINT END AS months, CASE WHEN p_size > 25 THEN 'invalid_salary' END AS warning FROM part")
def salary_parse(t: Tables):
    text = F.concat(F.col("p_size").cast("string"), F.lit("-25K·13薪"))
    return t.part.select("p_partkey", C.salary(text).alias("s")).select("p_partkey", "s.*")


@query("SELECT doc_id, (contains(lower(text), 'license')::INT + contains(lower(text), 'public')::INT + contains(lower(text), 'worthless')::INT) AS hits, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), 'the') THEN 'english' ELSE 'other' END AS kind FROM documents")
def keyword_hits(t: Tables):
    return t.documents.select("doc_id", C.keyword_hits(F.col("text"), ["license", "public", "worthless"]).alias("hits"), C.ordered_match(F.col("text"), {"license": "legal", "the": "english"}, "other").alias("kind"))


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events WHERE json_extract(props, '$.k')::INT >= 90")
def json_projection(t: Tables):
    k = F.from_json("props", "k int")["k"]
    return t.events.select("event_id", k.alias("k")).where("k >= 90")


@query("SELECT p_partkey, nullif(nullif(trim(p_brand), ''), '-') AS brand, try_cast(trunc(try_cast(regexp_replace(p_brand, '^Brand#', '') AS DOUBLE)) AS INT) AS number, array_to_string(list_transform(list_filter(string_split(p_name || ',, ' || p_type, ','), lambda x: trim(x) <> ''), lambda x: trim(x)), '|') AS parts FROM part")
def clean_fields(t: Tables):
    number = C.tolerant_int(F.regexp_replace("p_brand", "^Brand#", ""))
    return t.part.select("p_partkey", C.blank_to_null(F.col("p_brand")).alias("brand"), number.alias("number"), F.array_join(C.delimited(F.concat("p_name", F.lit(",, "), "p_type")), "|").alias("parts"))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '')) AS folded, lower(replace(p_name, ' ', '')) AS compared, p_name AS display FROM part")
def normalize_names(t: Tables):
    return t.part.select("p_partkey", S.normalized_name("p_name").alias("folded"), S.comparison_name("p_name").alias("compared"), S.display_name("p_name").alias("display"))


@query()
def normalize_unicode(t: Tables):
    return t.documents.select("doc_id", F.md5(S.normalized_name("text").cast("binary")).alias("folded"))


@query()
def html_text(t: Tables):
    return t.pages.select("page_id", H.parsed("html").alias("p")).select("page_id", "p.title", F.length("p.text").alias("n_chars"), F.md5(F.col("p.text").cast("binary")).alias("digest"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(t: Tables):
    return t.pages.select("page_id", F.explode(H.parsed("html")["links"]).alias("l")).select("page_id", "l.href")


@query("SELECT page_id, contains(lower(html), 'captcha') OR contains(lower(html), 'access denied') AS blocked, (contains(lower(url), 'career')::INT + contains(lower(html), 'apply')::INT + contains(lower(html), 'job')::INT) >= 2 AS recruiting FROM pages")
def page_decisions(t: Tables):
    low = F.lower("html")
    signals = F.lower("url").contains("career").cast("int") + low.contains("apply").cast("int") + low.contains("job").cast("int")
    return t.pages.select("page_id", (low.contains("captcha") | low.contains("access denied")).alias("blocked"), (signals >= 2).alias("recruiting"))
