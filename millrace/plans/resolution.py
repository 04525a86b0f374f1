"""Entity resolution over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import frontier as C
from ..operators import graph as G
from ..operators import relational as R
from ..operators import resolve as E
from .base import Tables, also, query


@query("""
WITH RECURSIVE p AS (SELECT p_partkey AS id, p_name AS a, p_brand || '/' || p_size || '/' || p_type AS b FROM part),
e AS (SELECT x.id AS u, y.id AS v FROM p x JOIN (SELECT b, min(id) AS id FROM p GROUP BY b) y USING (b) UNION SELECT y.id, x.id FROM p x JOIN (SELECT b, min(id) AS id FROM p GROUP BY b) y USING (b)),
r AS (SELECT id, id AS reach FROM p UNION SELECT r.id, e.v FROM r JOIN e ON r.reach = e.u)
SELECT id, min(reach) AS component FROM r GROUP BY id
""")
def name_groups(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), "p_type").alias("k"))
    return G.grouped_by_shared_keys(rows, "id", ["k"])


#: Eight rounds of least labels: enough for any two parts of an order line's graph, which are at most a few links apart.
_ROUNDS = "".join(f", l{i} AS (SELECT b.u, least(any_value(x.l), min(y.l)) AS l FROM b JOIN l{i - 1} x ON b.u = x.u JOIN l{i - 1} y ON b.v = y.u GROUP BY b.u)" for i in range(1, 9))


@query(f"""
WITH e AS (SELECT DISTINCT 2 * l_partkey AS u, 2 * l_suppkey + 1 AS v FROM lineitem), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), l0 AS (SELECT DISTINCT u, u AS l FROM b){_ROUNDS}
SELECT u AS id, l AS component FROM l8
""")
def fuzzy_components(t: Tables):
    """Parts (even ids) and suppliers (odd ids) that order lines link."""
    return G.connected_components(t.lineitem.select((2 * F.col("l_partkey")).alias("a"), (2 * F.col("l_suppkey") + 1).alias("b")))


also("part_supplier_components", "fuzzy_components")


_GRAMS = "list_distinct(flatten(list_transform(string_split(lower(name), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _neighbours_sql(names: str) -> str:
    return f"""
WITH n AS ({names}), g AS (SELECT id, {_GRAMS} AS t FROM n), e AS (SELECT id, len(t) AS n, unnest(t) AS t FROM g),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c, a.n AS an, b.n AS bn FROM e a JOIN e b ON a.t = b.t AND a.id <> b.id GROUP BY ALL),
s AS (SELECT a, b, 1 - c / (an + bn - c)::DOUBLE AS distance FROM p WHERE c > 0), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b)::INT AS place FROM s)
SELECT a, b, round(distance, 6) AS distance, place FROM r WHERE place <= 5
"""


@query(_neighbours_sql("SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name"))
def trigram_neighbors(t: Tables):
    names = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return E.trigram_neighbours(names, names, 5).withColumn("distance", F.round("distance", 6))


@query(_neighbours_sql("SELECT c_custkey AS id, c_name AS name FROM customer"))
def customer_neighbors(t: Tables):
    """Names that all begin alike, so that most trigrams are in all of them."""
    names = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return E.trigram_neighbours(names, names, 5).withColumn("distance", F.round("distance", 6))


@query()
def similar_names(t: Tables):
    names = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return E.rescored(E.trigram_neighbours(names, names, 20), names, names, 60).select("a", "b", F.round("score", 6).alias("score"))


@query()
def similar_titles(t: Tables):
    """Parts of odd keys against those of even keys, by brand and type: titles that are alike but for a word or two, or not at all."""
    words = F.element_at(F.array(*map(F.lit, ("mark one", "mark two", "second edition", "large", "large size", ""))), (F.expr("p_partkey div 2") % 6 + 1).cast("int"))
    titles = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("owner"), F.col("p_type").alias("city"), F.concat_ws(" ", "p_name", words).alias("title"))
    return E.resolved_titles(titles.where("id % 2 = 1"), titles.where("id % 2 = 0")).select("id", "known", F.round("score", 6).alias("score"))


@query("""
WITH c AS (SELECT p_name, count(DISTINCT p_brand) AS owners, bool_or(p_size > 49) AS conflicts, count(*) FILTER (WHERE p_type = 'PROMO') AS near, min(length(p_name)) <= 8 AS short FROM part GROUP BY 1),
d AS (SELECT p_name, owners % 3 AS owners, conflicts, near % 2 AS near, short FROM c)
SELECT p_name, CASE WHEN owners > 1 THEN 'review' WHEN owners = 1 AND NOT conflicts THEN 'existing' WHEN owners = 1 THEN 'review' WHEN near > 0 THEN 'review' ELSE 'new' END AS kind,
  concat_ws(',', CASE WHEN owners > 1 THEN 'ambiguous_owner' END, CASE WHEN owners = 1 AND conflicts THEN 'conflicting_evidence' END, CASE WHEN owners = 0 AND near > 0 AND short THEN 'short_name' END, CASE WHEN owners = 0 AND near > 0 THEN 'similar_name' END) AS reasons FROM d
""")
def resolver_decisions(t: Tables):
    seen = t.part.groupBy("p_name").agg((F.countDistinct("p_brand") % 3).alias("owners"), F.bool_or(F.col("p_size") > 49).alias("conflicts"), (F.count_if(F.col("p_type") == "PROMO") % 2).alias("near"), (F.min(F.length("p_name")) <= 8).alias("short"))
    kind, reasons = E.decision(F.col("owners"), F.col("conflicts"), F.lit(True), F.col("near"), F.col("short"))
    return seen.select("p_name", kind.alias("kind"), F.array_join(reasons, ",").alias("reasons"))


also("all_resolver_decisions", "resolver_decisions")


@query("""
WITH f AS (SELECT 'shared_name' AS code, 'high' AS severity, p_name AS subject FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1
UNION ALL SELECT 'unlabelled', 'low', doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'name_drift', 'medium', c_custkey::VARCHAR FROM customer WHERE lower(c_name) <> c_name)
SELECT *, sha256(code || '|' || subject) AS finding_id FROM f
""")
def audit_findings(t: Tables):
    shared = R.shared_keys(t.part, "p_name", "p_brand").select(F.col("p_name").alias("subject"))
    orphan = R.orphans(t.documents.select("doc_id"), t.labels, "doc_id", "doc_id").select(F.col("doc_id").alias("subject"))
    drift = t.customer.where("lower(c_name) <> c_name").select(F.col("c_custkey").alias("subject"))
    return E.findings(("shared_name", "high", shared), ("unlabelled", "low", orphan), ("name_drift", "medium", drift))


also("all_audit_findings", "audit_findings")


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT href, count(DISTINCT page_id) AS pages FROM l WHERE starts_with(href, '/') GROUP BY href
""")
def link_frontier(t: Tables):
    """One round of a bounded crawl: links found on known pages, by how many pages have them."""
    links = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    return links.where(F.col("href").startswith("/")).groupBy("href").agg(F.countDistinct("page_id").alias("pages"))


@query()
def site_frontier(t: Tables):
    """A crawl of every site from all of its known pages, as deep as the survey's and without its bound on pages and paths, so that no page is left out."""
    links = t.pages.select("page_id", F.posexplode(H.parsed("html")["links"]).alias("at", "l")).select("page_id", "at", F.col("l.href").alias("href"))
    return C.crawled(t.pages.select("page_id", "url"), links, t.pages.select(F.col("page_id").alias("at"), "url"), max_pages=None, prefixes=None)
