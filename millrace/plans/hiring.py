"""Company names, job cards and recruiting sites, over texts made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import jobs as J
from ..functions import similarity as S
from ..operators import hiring as H
from ..operators import ranking as K
from ..operators import resolve as E
from .base import Tables, query


def _of(number: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _sql(number: str, values: list[str]) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({number} % {len(values)} + 1)::INT]"


_PLACES, _ENDINGS = ["北京", "上海", "广州市", ""], ["科技有限公司", "集团公司", "数据公司", ""]


def _cut(x: str) -> str:
    for ending in ("有限公司", "集团", "研究院", "公司", "科技", "信息技术", "数据", "人工智能", "数智"):
        x = f"regexp_replace({x}, '{ending}$', '')"
    return x


@query(f"""
WITH n AS (SELECT p_partkey, replace({_sql('p_size', _PLACES)} || p_name || {_sql('p_partkey', _ENDINGS)}, ' ', '') AS compact FROM part),
b AS (SELECT *, regexp_replace(compact, '^(北京|上海|天津|重庆|广州|深圳|杭州|成都|武汉|厦门|苏州)', '') AS bare FROM n), c AS (SELECT *, {_cut('bare')} AS core FROM b), h AS (SELECT *, CASE WHEN length(core) >= 3 AND regexp_matches(core, '[一-龥]') THEN substr(core, 1, 3) END AS head FROM c)
SELECT p_partkey, concat_ws('|', CASE WHEN length(compact) >= 3 THEN compact END, CASE WHEN length(bare) >= 3 AND bare <> compact THEN bare END, CASE WHEN length(core) >= 3 AND core NOT IN (compact, bare) THEN core END, CASE WHEN head NOT IN (compact, bare, core) THEN head END) AS variants FROM h
""")
def name_variants(t: Tables):
    name = F.concat(_of(F.col("p_size"), _PLACES), "p_name", _of(F.col("p_partkey"), _ENDINGS))
    return t.part.select("p_partkey", F.array_join(J.variants(name), "|").alias("variants"))


_LEGAL = ["科技有限公司", "（集团）有限公司", "责任公司", "软件", "·控股-集团"]


@query(f"SELECT p_partkey, p_name || {_sql('p_partkey', ['', '', '责任', '', ''])} AS bare FROM part")
def legal_names(t: Tables):
    name = F.concat(_of(F.col("p_size"), ["", "广东省深圳市", "中国·", "上海市（"]), "p_name", _of(F.col("p_partkey"), _LEGAL))
    return t.part.select("p_partkey", J.without_legal_suffixes(name).alias("bare"))


_KINDS = ["实习生", "Part time", "外包", "全职 dev", "x", "Intern 全职"]
_CITIES = ["上海/北京", "remote job", "驻乌鲁木齐", "nowhere", "呼和浩特 南京"]


@query(f"SELECT o_orderkey, {_sql('o_orderkey', ['internship', 'part_time', 'temporary', 'full_time', '', 'internship'])} AS kind, {_sql('o_custkey', ['北京', '远程', '乌鲁木齐', '', '呼和浩特'])} AS city FROM orders")
def card_fields(t: Tables):
    kind, city = J.employment_type(_of(F.col("o_orderkey"), _KINDS)), J.city(_of(F.col("o_custkey"), _CITIES))
    return t.orders.select("o_orderkey", F.coalesce(kind, F.lit("")).alias("kind"), F.coalesce(city, F.lit("")).alias("city"))


_FORMS = ["{}-{}K·14薪", "{}-{}万", "{}-{}", "{}-{}K/天", "3-5年经验 {}-{}k", "8千-1.2万", "{}.5-{}.5k", "30-60万/年"]


@query("""
WITH c AS (SELECT p_partkey, p_partkey % 8 AS form, p_size AS a, p_size + 10 AS b FROM part)
SELECT p_partkey, CASE WHEN form IN (0, 4) THEN a WHEN form = 1 AND b <= 50 THEN 10 * a WHEN form = 6 THEN round_even(a + 0.5, 0)::INT END AS low,
  CASE WHEN form IN (0, 4) THEN b WHEN form = 1 AND b <= 50 THEN 10 * b WHEN form = 6 THEN round_even(b + 0.5, 0)::INT END AS high, CASE WHEN form = 0 THEN 14 END AS months FROM c
""")
def card_salaries(t: Tables):
    text = F.replace(F.replace(_of(F.col("p_partkey"), [f.replace("{}", "<", 1).replace("{}", ">", 1) for f in _FORMS]), F.lit("<"), F.col("p_size").cast("string")), F.lit(">"), (F.col("p_size") + 10).cast("string"))
    return t.part.select("p_partkey", J.salary(text).alias("s")).select("p_partkey", "s.*")


@query("SELECT p_partkey, lower(replace(p_name, ' ', '')) AS title, CASE p_size % 3 WHEN 0 THEN 'internship' WHEN 1 THEN 'experienced' ELSE 'unknown' END AS job_type, CASE WHEN p_size % 3 = 2 THEN '' ELSE lower(p_brand) END AS city, p_size * 1000 AS low FROM part")
def normalized_jobs(t: Tables):
    """Facts as normalised jobs: type by employment type, folded title and city (none: empty), salary."""
    kind = F.when(F.col("p_size") % 3 == 0, "internship").when(F.col("p_size") % 3 == 1, "experienced").otherwise("unknown")
    city = F.when(F.col("p_size") % 3 != 2, F.col("p_brand"))
    pay = C.salary(F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 1).cast("string"), F.lit("K")))
    facts = t.part.select("p_partkey", "p_name", kind.alias("job_type"), F.coalesce(city, F.lit("")).alias("place"), pay.alias("pay"))
    return facts.select("p_partkey", S.normalized_name("p_name").alias("title"), "job_type", S.normalized_name("place").alias("city"), F.col("pay.low").alias("low"))


_URLS = [
    "https://jobs.lever.co/acme{}/x", "https://jobs.lever.co/", "https://boards.greenhouse.io/embed/job_board?for=b{}&x=1", "https://boards.greenhouse.io/embed/job_board?for=a&for=b", "https://apply.workable.com/j/K{}", "https://www.example.com/jobs/{}",
    "https://acme{}.wd5.myworkdayjobs.com/site", "https://acme.myworkdayjobs.com/site", "https://wd1.myworkdaysite.com/recruiting/t{}/x", "https://jobs.lever.co/-bad",
]
_IDENTITIES = [
    "tenant:jobs.lever.co:acme{}", "", "tenant:boards.greenhouse.io:b{}", "", "url:https://apply.workable.com/j/K{}", "url:https://www.example.com/jobs/{}",
    "tenant:acme{}.wd5.myworkdayjobs.com", "", "tenant:wd1.myworkdaysite.com:t{}", "",
]


@query(f"SELECT p_partkey, replace({_sql('p_partkey', _IDENTITIES)}, '{{}}', p_size::VARCHAR) AS identity, p_partkey % 10 IN (1, 3, 7, 9) AS ambiguous FROM part")
def recruitment_identities(t: Tables):
    url = F.replace(_of(F.col("p_partkey"), _URLS), F.lit("{}"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", H.recruitment_identity(url).alias("r")).select("p_partkey", F.coalesce("r.identity", F.lit("")).alias("identity"), "r.ambiguous")


_LABELS = ["天使轮", "Pre-A轮", "A 轮", "B轮", "D轮", "IPO", "并购", "种子"]
_STAGES = ["angel", "pre_a", "series_a", "series_b", "series_c_plus", "public", "", "seed"]


@query(f"""
WITH s AS (SELECT user_id, ts, event_id, {_sql('event_id', _STAGES)} AS stage FROM events WHERE event_type = 'purchase')
SELECT user_id, coalesce(arg_max(stage, (ts, event_id)) FILTER (WHERE stage <> ''), 'unknown') AS stage FROM s GROUP BY user_id
""")
def funding_stages(t: Tables):
    signals = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id", _of(F.col("event_id"), _LABELS).alias("label"))
    return H.latest_stage(signals, "user_id", "label", "ts", "event_id")


@query("""
WITH i AS (SELECT o_orderkey AS row_id, o_orderpriority AS kind, upper(o_orderpriority) || (o_custkey % 50) AS normal, o_orderpriority || (o_custkey % 50) || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END AS number FROM orders),
s AS (SELECT o_orderkey AS id, o_orderpriority AS kind, upper(o_orderpriority) || (o_custkey % 50) AS normal, o_orderpriority || (o_custkey % 50) || CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE '' END AS number FROM orders WHERE o_orderstatus = 'P'),
r AS (SELECT kind, normal, number, min(id) AS id FROM s GROUP BY ALL), a AS (SELECT kind, normal, min(id) AS id FROM s GROUP BY ALL)
SELECT i.row_id, coalesce(r.id, a.id) AS id FROM i LEFT JOIN r USING (kind, normal, number) LEFT JOIN a ON i.kind = a.kind AND i.normal = a.normal
""")
def filings_identity(t: Tables):
    normal = F.concat(F.upper("o_orderpriority"), (F.col("o_custkey") % 50).cast("string"))
    raw = lambda k: F.concat("o_orderpriority", (F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_orderkey") % k == 0, " ").otherwise(""))
    incoming = t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("kind"), normal.alias("normal"), raw(2).alias("number"))
    stored = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), normal.alias("normal"), raw(3).alias("number"))
    stored = stored.groupBy("kind", "normal", "number").agg(F.min("id").alias("id"))
    return H.filings_matched(stored, incoming, ["kind"], "number", "normal").select("row_id", "id")


@query("""
WITH c AS (SELECT o_orderkey AS row_id, o_custkey % 12 AS company, o_orderpriority AS title, coalesce(nullif(o_orderstatus, 'P'), '') AS city,
    CASE WHEN o_orderkey % 5 = 0 THEN 's' || o_orderkey ELSE 'n' || (o_orderkey // 6) END AS raw_id FROM orders),
j AS (SELECT min(row_id) AS job_id, company, title, city FROM c WHERE row_id % 25 = 0 GROUP BY ALL),
s AS (SELECT 's' || job_id AS raw_id, job_id, company AS owner FROM j),
f AS (SELECT c.*, s.job_id AS known, s.owner FROM c LEFT JOIN s USING (raw_id)),
o AS (SELECT *, arg_min(row_id, row_id) OVER w AS opener, first_value(company) OVER w AS opened_by FROM f WHERE known IS NULL WINDOW w AS (PARTITION BY raw_id ORDER BY row_id)),
n AS (SELECT o.row_id, o.raw_id, j.job_id, CASE WHEN j.job_id IS NULL THEN min(o.row_id) OVER (PARTITION BY o.company, o.title, o.city) END AS made_by
  FROM o LEFT JOIN j ON o.company = j.company AND o.title = j.title AND o.city = j.city WHERE o.row_id = o.opener)
SELECT row_id, CASE WHEN owner = company THEN 'refreshed' ELSE 'conflict' END AS action, known AS job_id, NULL::BIGINT AS made_by FROM f WHERE known IS NOT NULL
UNION ALL SELECT row_id, CASE WHEN row_id = made_by THEN 'job_created' ELSE 'source_added' END, job_id, made_by FROM n
UNION ALL SELECT o.row_id, CASE WHEN o.company = o.opened_by THEN 'refreshed' ELSE 'conflict' END, n.job_id, n.made_by FROM o JOIN n USING (raw_id) WHERE o.row_id <> o.opener
""")
def enumeration_persist(t: Tables):
    """Orders as enumerated jobs: raw ids repeat within the batch, also for other companies, and cities may be null."""
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("n"), F.expr("o_orderkey div 6").cast("string")))
    o = t.orders.select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 12).alias("company"), F.lit("p").alias("provider"), raw.alias("raw_id"),
        F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("city"),
    )
    jobs = o.where("row_id % 25 = 0").groupBy("company", "title", "city").agg(F.min("row_id").alias("job_id"))
    sources = jobs.select(F.lit("p").alias("provider"), F.concat(F.lit("s"), F.col("job_id").cast("string")).alias("raw_id"), "job_id")
    return H.persisted(o, sources, jobs)


@query("""
WITH e AS (SELECT p_brand AS company, p_name AS name FROM part UNION SELECT p_brand, p_type FROM part UNION SELECT p_brand, lower(replace(p_name, ' ', '')) FROM part)
SELECT company, array_to_string(list_sort(list(DISTINCT name)), '|') AS names FROM e WHERE trim(name) <> '' GROUP BY company
""")
def alias_sets(t: Tables):
    p = t.part.withColumnRenamed("p_brand", "company")
    own = p.select("company", F.array("p_type", F.lit(" ")).alias("names"))
    return H.alias_sets(own, p.select("company", F.col("p_name").alias("alias"), S.normalized_name("p_name").alias("normalized"))).select("company", F.array_join("names", "|").alias("names"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn <= 3")
def most_confident(t: Tables):
    return H.most_confident(t.events.select("user_id", "event_id", "value"), "user_id", "value", "event_id", 3).select("user_id", "event_id")


@query("""
WITH f AS (SELECT 'large' AS code, CASE WHEN p_size > 40 THEN 'high' ELSE 'low' END AS severity, p_partkey::VARCHAR AS subject, sha256('large|' || p_partkey) AS finding_id FROM part),
o AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 1 ELSE 3 END, code, subject, finding_id) AS place FROM f)
SELECT code, severity, subject, place FROM o WHERE place <= 100 UNION ALL SELECT 'truncated', 'info', NULL, 101 WHERE (SELECT count(*) FROM f) > 100
""")
def ordered_findings(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("subject"), "p_size")
    every = E.findings(("large", "high", rows.where("p_size > 40")), ("large", "low", rows.where("p_size <= 40")))
    return H.ordered_findings(every, ["high", "medium", "low"], 100).select("code", "severity", "subject", F.col("place").cast("long").alias("place"))


@query("SELECT o_custkey, count(*) AS n, count(*) > 12 AS gives_up FROM orders GROUP BY 1")
def overflow_probe(t: Tables):
    return H.overflowing(t.orders, "o_custkey", 12)


@query("SELECT user_id, list_has_all(['view', 'click', 'signup'], list(DISTINCT event_type)) AS within, list_has_any(['purchase', 'refund'], list(DISTINCT event_type)) AS meets FROM events WHERE value > 80 GROUP BY 1")
def set_tests(t: Tables):
    """Subset and overlap of a user's kinds with fixed sets."""
    kinds = t.events.where("value > 80").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    known, wanted = F.array(*map(F.lit, ["view", "click", "signup"])), F.array(F.lit("purchase"), F.lit("refund"))
    return kinds.select("user_id", (F.size(F.array_except("k", known)) == 0).alias("within"), F.arrays_overlap("k", wanted).alias("meets"))


@query("SELECT p_partkey, contains(lower(replace(p_name, ' ', '')), lower(split_part(p_name, ' ', 2))) AS own, contains(lower(replace(p_name, ' ', '')), 'red') AS red FROM part")
def mentions(t: Tables):
    text = S.comparison_name("p_name")
    named = t.part.select("p_partkey", text.alias("text"), S.comparison_name(F.substring_index("p_name", " ", -1)).alias("last"))
    return named.select("p_partkey", H.mentioned(F.col("last"), F.col("text")).alias("own"), H.mentioned(F.lit("red"), F.col("text")).alias("red"))


@query("SELECT p_partkey, 'https://jobs.feishu.cn/a' || p_size || '|https://www.lagou.com/jobs/' || p_partkey AS urls FROM part")
def site_urls(t: Tables):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit("see https://www.lagou.com/jobs/"), key, F.lit("/ or https://jobs.feishu.cn/a"), size, F.lit("，https://jobs.feishu.cn/a"), size, F.lit("/ https://example.com/b"))
    return t.part.select("p_partkey", F.array_join(H.site_urls(text), "|").alias("urls"))


@query("SELECT p_partkey, p_size % 4 IN (0, 1) AS inside, p_size % 4 <> 3 AS fixed FROM part")
def scope_checks(t: Tables):
    url = _of(F.col("p_size"), ["https://a.example/jobs", "https://a.example/jobs/1", "https://a.example/jobsx", "http://a.example/jobs?x=1"])
    return t.part.select("p_partkey", H.in_scope(url, F.lit("https://a.example/jobs/")).alias("inside"), H.static_url(url).alias("fixed"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AS valid FROM part")
def uuid_checks(t: Tables):
    digest = F.md5(F.col("p_partkey").cast("string").cast("binary"))
    dashed = F.concat_ws("-", F.substr(digest, F.lit(1), F.lit(8)), F.substr(digest, F.lit(9), F.lit(4)), F.substr(digest, F.lit(13), F.lit(4)), F.substr(digest, F.lit(17), F.lit(4)), F.substr(digest, F.lit(21), F.lit(12)))
    return t.part.select("p_partkey", H.uuid_like(F.when(F.col("p_partkey") % 2 == 0, F.upper(dashed)).otherwise(digest)).alias("valid"))


@query("WITH d AS (SELECT DISTINCT p_brand, p_name FROM part), i AS (SELECT DISTINCT p_brand FROM d WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 50)) SELECT d.p_brand, d.p_name FROM d JOIN i USING (p_brand)")
def decision_closure(t: Tables):
    """All names of the brands that share a name with parts of the largest size."""
    return H.closure(t.part.where("p_size = 50"), t.part.select("p_brand", "p_name").distinct(), "p_name", "p_brand")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN NULL ELSE ts END DESC NULLS LAST, event_id) AS place FROM events")
def events_null_last(t: Tables):
    at = F.when(F.col("event_type") != "error", F.col("ts"))
    return t.events.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(at.desc_nulls_last(), "event_id")).cast("long").alias("place"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-06-01' THEN 'requeue' WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 AND o_orderdate < TIMESTAMP '1998-06-01' THEN 'dispatch' END AS action FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' AND (o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_custkey % 2 = 0))")
def stale_queue(t: Tables):
    """Runs to take up again: running ones started before the limit, queued ones without a task created before it."""
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    action = F.when(F.col("o_orderstatus") == "O", "requeue").when((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 2 == 0), "dispatch")
    return t.orders.where(F.col("o_orderdate") < cut).select("o_orderkey", action.alias("action")).where("action IS NOT NULL")


@query("""
WITH r AS (SELECT c_custkey AS id, c_acctbal, CASE WHEN c_acctbal > 0 THEN row_number() OVER (PARTITION BY c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey) END AS rank FROM customer)
SELECT id, rank, CASE WHEN rank IS NULL THEN 'observation' ELSE 'ranked' END AS status, 'growth' AS stage, c_acctbal AS total, CASE WHEN c_acctbal >= 1000 THEN 'balance' ELSE 'base' END AS reason, CASE WHEN c_acctbal <= 0 THEN 'positive' ELSE '' END AS missing FROM r
""")
def ranking_items(t: Tables):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("total"), F.col("c_acctbal").alias("balance"), F.lit(1000.0).alias("base"), (-F.col("c_acctbal")).alias("_first"), (F.col("c_acctbal") > 0).alias("positive"), F.lit(None).cast("string").alias("stage"))
    placed = K.ranked(rows, F.col("positive"), ["_first", "id"]).withColumn("rank", F.col("rank").cast("long"))
    return H.report_items(placed, ["balance", "base"], ["positive"])
