"""Recruiting sites and what is collected from them: whose site a URL is, filings, enumerated jobs, aliases, report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hosts that many companies share, told apart by the first part of the path (fixed values).
SHARED_HOSTS = ["apply.workable.com", "boards.greenhouse.io", "careers.smartrecruiters.com", "job-boards.greenhouse.io", "jobs.ashbyhq.com", "jobs.lever.co"]
#: Those of them that embed a board by a query parameter (fixed values).
EMBEDDING_HOSTS = ["boards.greenhouse.io", "job-boards.greenhouse.io"]
#: Addresses of job sites within text (fixed values).
SITE_PATTERNS = [
    r"https?://jobs\.feishu\.cn/[a-zA-Z0-9_@./#?&=-]+", r"https?://app\.mokahr\.com/[a-zA-Z0-9_@./#?&=-]+", r"https?://(?:www\.)?liepin\.com/[a-zA-Z0-9_@./#?&=-]+",
    r"https?://(?:www\.)?lagou\.com/[a-zA-Z0-9_@./#?&=-]+", r"https?://jobs\.bytedance\.com/[a-zA-Z0-9_@./#?&=-]+",
]
_SEGMENT = r"\A[A-Za-z0-9][A-Za-z0-9._~-]{0,127}\z"


def recruitment_identity(url: Column) -> Column:
    """Struct (identity, ambiguous) of a normalised URL. On shared hosts it is the tenant, else the URL; a URL that is
    broken, or on a shared host without a tenant, is ambiguous; no URL is no evidence."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.\z", "")
    path = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    part = lambda i: F.get(path, F.lit(i))
    good = lambda c: F.coalesce(c.rlike(_SEGMENT), F.lit(False))
    wanted = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: p.startswith("for="))
    boards = F.filter(F.transform(wanted, lambda p: F.url_decode(F.substr(p, F.lit(5)))), good)
    tenant = lambda name: F.concat(F.lit("tenant:"), host, F.lit(":"), name)
    shared = (
        F.when(host.isin(EMBEDDING_HOSTS) & (part(0) == "embed"), F.when(F.size(boards) == 1, tenant(F.get(boards, F.lit(0)))))
        .when((host == "apply.workable.com") & (part(0) == "j"), F.when(good(part(1)), F.concat(F.lit("url:"), url))).when(good(part(0)), tenant(part(0)))
    )
    site = F.when((part(0) == "recruiting") & good(part(1)), tenant(part(1)))
    labels = F.filter(F.split(F.regexp_replace(host, r"\.myworkdayjobs\.com\z", ""), r"\."), lambda x: x != "")
    own = F.when((F.size(labels) >= 2) & good(F.get(labels, F.lit(0))) & F.element_at(labels, -1).rlike(r"\Awd[0-9]+\z"), F.concat(F.lit("tenant:"), host))
    identity = F.when(host.isin(SHARED_HOSTS), shared).when(host.endswith(".myworkdaysite.com"), site).when(host.endswith(".myworkdayjobs.com"), own).when(host.isNotNull(), F.concat(F.lit("url:"), url))
    return F.struct(identity.alias("identity"), (url.isNotNull() & identity.isNull()).alias("ambiguous"))


def site_urls(text: Column) -> Column:
    """The distinct job-site addresses in a text, without trailing slashes, sorted."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 0) for p in SITE_PATTERNS]))
    return F.array_sort(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"/+\z", ""))))


def in_scope(url: Column, base: Column) -> Column:
    """Whether a URL lies under another: same scheme and authority, and its path or one below."""
    piece = lambda u, k: F.coalesce(F.try_parse_url(u, F.lit(k)), F.lit(""))
    root = F.regexp_replace(piece(base, "PATH"), r"/+\z", "")
    same = (piece(url, "PROTOCOL") == piece(base, "PROTOCOL")) & (piece(url, "AUTHORITY") == piece(base, "AUTHORITY"))
    return same & ((root == "") | (piece(url, "PATH") == root) | F.startswith(piece(url, "PATH"), F.concat(root, F.lit("/"))))


def static_url(url: Column) -> Column:
    return url.isNotNull() & ~F.coalesce(url.rlike(r"[?#]."), F.lit(False))


def uuid_like(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), F.lit(False))


def mentioned(name: Column, text: Column) -> Column:
    """Whether a text holds a name; both in comparison form. An empty name is never mentioned."""
    return F.coalesce((name != "") & F.contains(text, name), F.lit(False))


#: Labels of financing rounds, and the stages that they name (fixed values).
SEED_LABELS, ANGEL_LABELS = ["种子轮", "种子"], ["天使轮", "天使"]
LATE_LABELS, PUBLIC_LABELS = ["c轮", "d轮", "e轮", "f轮"], ["ipo", "上市"]
ROUND, PRE_A, PRE_B = "轮", "pre-a", "pre-b"


def funding_stage(label: Column) -> Column:
    """The stage that a financing label names; null where it names none."""
    low = F.replace(F.lower(F.trim(label)), F.lit(" "), F.lit(""))
    a_round = low.contains("a") & low.contains(ROUND) & ~low.contains(PRE_B)
    b_round = low.startswith(PRE_B) | (low.contains("b") & low.contains(ROUND))
    return (
        F.when(low.isin(SEED_LABELS), "seed").when(low.isin(ANGEL_LABELS), "angel").when(low.startswith(PRE_A), "pre_a").when(a_round, "series_a")
        .when(b_round, "series_b").when(low.rlike("|".join(LATE_LABELS)), "series_c_plus").when(low.rlike("|".join(PUBLIC_LABELS)), "public")
    )


def latest_stage(signals: DataFrame, key: str, label: str, date: str, tie: str) -> DataFrame:
    """(key, stage): of the latest label that names a stage (undated ones first of all), `unknown` without one."""
    staged = signals.withColumn("_stage", funding_stage(F.col(label)))
    order = F.when(F.col("_stage").isNotNull(), F.struct(F.coalesce(F.col(date).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("d"), F.col(tie).alias("t")))
    return staged.groupBy(key).agg(F.coalesce(F.max_by("_stage", order), F.lit("unknown")).alias("stage"))


def filings_matched(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], number: str, normal: str) -> DataFrame:
    """Incoming filings (row_id, keys, number) with the stored one (id) of equal keys and normalised number: one whose raw number is
    equal goes first, then the smallest id. Without one `id` is null: it is new."""
    own = stored.select(*keys, normal, F.col(number).alias("_stored"), F.col("id"))
    met = incoming.join(own, [*keys, normal], "left")
    best = F.min(F.struct((F.col("_stored") != F.col(number)).alias("other"), "id"))
    return met.groupBy("row_id", *keys, normal, number).agg(best["id"].alias("id"))


def persisted(candidates: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Enumerated jobs, as if they came one by one in the order of row_id: (row_id, action, job_id, made_by). candidates: row_id, company,
    provider, raw_id, title, city; sources: provider, raw_id, job_id; jobs: job_id, company, title, city; a null city is "".

    A known source is refreshed, or a `conflict` if its job is another company's; so is one that an earlier candidate of the batch has just
    added. Else a job of equal company, title and city gets a source; else the first candidate of these makes the job and others join
    it: job_id is null then, and made_by names that candidate's row. A candidate without provider or raw_id has a source of its own."""
    candidates = candidates.withColumn("city", F.coalesce("city", F.lit("")))
    jobs = jobs.withColumn("city", F.coalesce("city", F.lit("")))
    owned = jobs.select("job_id", F.col("company").alias("_owner"))
    known = sources.join(owned, "job_id", "left").select("provider", "raw_id", F.col("job_id").alias("_job"), "_owner")
    first = candidates.join(known, ["provider", "raw_id"], "left")
    verdict = lambda owner: F.when(owner.eqNullSafe(F.col("company")), "refreshed").otherwise("conflict")
    seen = first.where("_job IS NOT NULL").select("row_id", verdict(F.col("_owner")).alias("action"), F.col("_job").alias("job_id"), F.lit(None).cast("long").alias("made_by"))

    rest = first.where("_job IS NULL").drop("_job", "_owner")
    openers = rest.where("provider IS NOT NULL AND raw_id IS NOT NULL").groupBy("provider", "raw_id").agg(F.min(F.struct("row_id", "company", "title", "city")).alias("_opener"))
    rest = rest.join(openers, ["provider", "raw_id"], "left").withColumn("_opener", F.coalesce("_opener", F.struct("row_id", "company", "title", "city")))
    opening = rest.where(F.col("row_id") == F.col("_opener.row_id"))
    named = jobs.groupBy("company", "title", "city").agg(F.min("job_id").alias("_same"))
    opening = opening.join(named, ["company", "title", "city"], "left")
    leads = opening.where("_same IS NULL").groupBy("company", "title", "city").agg(F.min("row_id").alias("_lead"))
    opened = opening.join(leads, ["company", "title", "city"], "left").select("row_id", F.col("_same").alias("job_id"), F.when(F.col("_same").isNull(), F.coalesce("_lead", "row_id")).alias("made_by"))
    new = opened.select("row_id", F.when(F.col("row_id") == F.col("made_by"), "job_created").otherwise("source_added").alias("action"), "job_id", F.col("made_by").cast("long").alias("made_by"))
    later = rest.where(F.col("row_id") != F.col("_opener.row_id")).select("row_id", verdict(F.col("_opener.company")).alias("action"), F.col("_opener.row_id").alias("_by"))
    later = later.join(opened.select(F.col("row_id").alias("_by"), "job_id", "made_by"), "_by").select("row_id", "action", "job_id", F.col("made_by").cast("long").alias("made_by"))
    return seen.unionByName(new).unionByName(later)


def alias_sets(companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """(company, names): its own names (an array) and all aliases, distinct, sorted, blank ones left out. Rows of one company only meet as
    distinct names."""
    every = companies.select("company", F.explode("names").alias("name")).unionByName(aliases.select("company", F.explode(F.array("alias", "normalized")).alias("name")))
    return every.where(F.trim("name") != "").groupBy("company").agg(F.array_sort(F.collect_set("name")).alias("names"))


def most_confident(items: DataFrame, key: str, confidence: str, position: str, n: int) -> DataFrame:
    """The n items of each key with the highest confidence, in their old order among equals."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(confidence), position))
    return items.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def ordered_findings(rows: DataFrame, severities: Sequence[str], n: int) -> DataFrame:
    """The first n findings by severity, code, subject and id, with `place` from 1; where more are there, one row `truncated` behind
    them. A top-n report: the limit is its purpose."""
    level = F.array_position(F.array(*map(F.lit, severities)), F.col("severity"))
    first = rows.withColumn("_level", level).orderBy("_level", "code", "subject", "finding_id").limit(n)
    told = first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_level", "code", "subject", "finding_id"))).drop("_level")
    over = rows.limit(n + 1).agg(F.count("*").alias("n")).where(F.col("n") > n)
    marker = over.select(F.lit("truncated").alias("code"), F.lit("info").alias("severity"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("finding_id"), F.lit(n + 1).alias("place"))
    return told.unionByName(marker)


def overflowing(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, n, gives_up): whether a key has more rows than can be looked at."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("gives_up", F.col("n") > limit)


def closure(decided: DataFrame, links: DataFrame, name: str, owner: str) -> DataFrame:
    """All links (name, owner) of the owners that share a name with the decided rows."""
    involved = links.join(decided.select(name).distinct(), name, "left_semi").select(owner).distinct()
    return links.join(involved, owner, "left_semi")


def report_items(rows: DataFrame, components: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Rows of a ranking as they are shown: status by eligibility, stage `growth` where unknown, the reason and what is missing."""
    top = F.greatest(*[F.col(c) for c in components])
    reason = F.coalesce(*[F.when(F.col(c) == top, F.lit(c)) for c in components])
    lacking = F.array_compact(F.array(*[F.when(~F.col(f), F.lit(f)) for f in flags]))
    return rows.select("id", "rank", F.when(F.col("rank").isNotNull(), "ranked").otherwise("observation").alias("status"), F.coalesce("stage", F.lit("growth")).alias("stage"), "total", reason.alias("reason"), F.array_join(F.array_sort(lacking), ",").alias("missing"))
