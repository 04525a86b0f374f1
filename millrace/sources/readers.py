"""Typed readers. Schemas are declared, never inferred; what breaks a rule is returned beside what keeps it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import similarity
from ..operators import relational as R

SEED = """version int, companies array<struct<canonical_name:string,aliases:array<string>,city:string,funding_stage:string,scale:string,
jobs:array<struct<title:string,job_type:string,city:string,salary_min_monthly:int,salary_max_monthly:int,description:string,posted_at:string,is_active:boolean,
sources:array<struct<provider:string,source_raw_id:string,apply_url:string,first_seen_at:string,last_seen_at:string,is_active:boolean>>>>>>"""
_JOB = "struct<id:string,code:string,name:string,title:string,url:string,location_names:array<string>,description:string,requirement:string>"
MAX_EXTERNAL_JOBS, MAX_REJECTED = 2000, 0.2


def seed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """companies, aliases, jobs and sources of seed files of version 1, keyed by company and job position."""
    rows = spark.read.schema(SEED).json(path, multiLine=True).where("version = 1")
    companies = rows.select(F.explode("companies").alias("c")).select("c.*")
    jobs = companies.select("canonical_name", F.posexplode("jobs").alias("position", "j")).select("canonical_name", "position", "j.*")
    return {
        "companies": companies.drop("aliases", "jobs"), "aliases": companies.select("canonical_name", F.explode("aliases").alias("alias")),
        "jobs": jobs.drop("sources"), "sources": jobs.select("canonical_name", "position", F.explode("sources").alias("s")).select("canonical_name", "position", "s.*"),
    }


def external_jobs(rows: DataFrame, text: str = "body") -> tuple[DataFrame, DataFrame]:
    """(jobs, verdict) of JSON texts that hold a list of jobs, or an object with it under jobs, items or data. A job needs an id (or code), a name
    (or title) and a url; if more than a fifth of a text's jobs lack one, or there are too many, the verdict fails all of them."""
    raw = F.col(text)
    listed = F.from_json(raw, f"array<{_JOB}>")
    boxed = F.from_json(raw, f"struct<jobs:array<{_JOB}>,items:array<{_JOB}>,data:array<{_JOB}>,pagination_complete:boolean,has_more:boolean>")
    whole = F.trim(raw).startswith("[")
    jobs = F.when(whole, listed).otherwise(F.coalesce(boxed["jobs"], boxed["items"], boxed["data"]))
    complete = F.when(whole, F.lit(True)).otherwise(F.coalesce(boxed["pagination_complete"], ~boxed["has_more"], F.lit(False)))
    keyed = rows.select("*", jobs.alias("_jobs"), complete.alias("complete"))

    def truthy(*values: Column) -> Column:
        return F.coalesce(*[C.blank_to_null(v) for v in values])

    one = keyed.select(*rows.columns, "complete", F.posexplode_outer("_jobs").alias("position", "j")).select(*[c for c in rows.columns if c != text], "complete", "position", truthy(F.col("j.id"), F.col("j.code")).alias("id"), truthy(F.col("j.name"), F.col("j.title")).alias("name"), truthy(F.col("j.url")).alias("url"), F.array_join("j.location_names", ",").alias("city"))
    good = one.where("id IS NOT NULL AND name IS NOT NULL AND url IS NOT NULL")
    keys = [c for c in rows.columns if c != text]
    verdict = one.groupBy(*keys, "complete").agg(F.count("position").alias("n"), F.count_if(F.col("position").isNotNull() & (F.col("id").isNull() | F.col("name").isNull() | F.col("url").isNull())).alias("rejected"))
    return good, verdict.withColumn("failed", (F.col("rejected") > MAX_REJECTED * F.col("n")) | (F.col("n") > MAX_EXTERNAL_JOBS))


def candidates(rows: DataFrame, required: list[str], name: str, status: str, wanted: str, order: str) -> DataFrame:
    """Rows of a staged workbook: all headers there, the wanted status, a name, and the first row of a name in source order."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing headers: {missing}")
    clean = rows.withColumns({c: C.blank_to_null(F.col(c).cast("string")) for c in required if c != order})
    return R.first_wins(clean.where((F.col(status) == wanted) & F.col(name).isNotNull()), [name], [F.col(order)])


def eligible(rows: DataFrame, order: str, name: str, status: str, statuses: list[str], code: str, score: str, known: list[str] = (), unknown: str = "") -> DataFrame:
    """Candidates of a workbook: rows with one of the statuses, a name, a code and a whole score; of equal names (white space and case
    aside) the first in source order. The code itself goes, its digest stays; columns in `known` are never null but `unknown`."""
    clean = rows.withColumns({c: C.blank_to_null(F.col(c).cast("string")) for c in [name, status, code, score, *known]})
    clean = clean.withColumn("normalized_name", similarity.comparison_name(F.col(name))).withColumn(score, C.tolerant_int(F.col(score)))
    kept = clean.where(F.col(status).isin(*statuses) & (F.length("normalized_name") > 0) & F.col(code).isNotNull() & F.col(score).isNotNull())
    first = R.first_wins(kept, ["normalized_name"], [F.col(order)])
    return first.withColumns({c: F.coalesce(c, F.lit(unknown)) for c in known}).withColumn("identity_hash", F.sha2(code, 256)).drop(code, status)


def cohort(rows: DataFrame, order: str, name: str, first: int = 3, last: int = 22) -> tuple[DataFrame, DataFrame]:
    """(the names of the rows first..last of each file, verdict): a file whose rows there aren't all named fails whole."""
    named = rows.where(F.col(order).between(first, last)).withColumn(name, C.blank_to_null(F.col(name).cast("string"))).where(F.col(name).isNotNull())
    verdict = rows.select("_file").distinct().join(named.groupBy("_file").agg(F.countDistinct(order).alias("named")), "_file", "left")
    verdict = verdict.select("_file", (F.coalesce("named", F.lit(0)) < last - first + 1).alias("failed"))
    return named.join(verdict.where("NOT failed").select("_file"), "_file", "left_semi").select("_file", order, name), verdict


def site_mapping(pairs: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, site, id) where the name is one company and neither name nor site occurs twice; the other pairs with `reason`."""
    known = companies.groupBy("name").agg(F.count("*").alias("owners"), F.min("id").alias("id"))
    names, sites = pairs.groupBy("name").agg(F.count("*").alias("n_name")), pairs.groupBy("site").agg(F.count("*").alias("n_site"))
    judged = pairs.join(names, "name").join(sites, "site").join(known, "name", "left")
    reason = F.when(F.col("n_name") > 1, "name_twice").when(F.col("n_site") > 1, "site_twice").when(F.col("owners").isNull(), "unknown_name").when(F.col("owners") > 1, "ambiguous_name")
    judged = judged.withColumn("reason", reason)
    return judged.where("reason IS NULL").select("name", "site", "id"), judged.where("reason IS NOT NULL").select("name", "site", "reason")


def typed(spark: SparkSession, path: str, schema: str, format: str = "parquet", **options: str) -> DataFrame:
    """A reader for any of Spark's formats with a declared schema."""
    return spark.read.format(format).schema(schema).options(**options).load(path)


MAX_LIST_BYTES = 8 << 20


def strict_list(rows: DataFrame, text: str, fields: str, key: str, most_bytes: int = MAX_LIST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(items, verdict) of JSON texts that must be lists of objects with exactly these fields (DDL), none too large, no `key` twice or null.
    A text that breaks a rule gives no item; the verdict names the first rule that it breaks, or null."""
    keys = [c for c in rows.columns if c != text]
    struct = f"struct<{', '.join(':'.join(f.split()) for f in fields.split(','))}>"
    names = [f.split()[0] for f in fields.split(",")]
    size = F.octet_length(text)
    told = rows.withColumn("_list", F.when(size <= most_bytes, F.from_json(text, f"array<{struct}>", {"mode": "PERMISSIVE"})))
    raw = F.when(size <= most_bytes, F.from_json(text, "array<map<string,string>>"))
    told = told.withColumn("_raw", raw).withColumn("_keys", F.transform("_list", lambda x: x[key]))
    odd = F.exists("_raw", lambda m: m.isNull() | (F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, names)))) > 0))
    lost = F.exists(F.arrays_zip("_raw", "_list"), lambda z: F.exists(F.map_keys(z["_raw"]), lambda k: z["_raw"][k].isNotNull() & F.element_at(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[z["_list"][n].cast("string") for n in names])), k).isNull()))
    reason = (
        F.when(F.col(text).isNull(), "missing").when(size > most_bytes, "too_large")
        .when(~F.coalesce(F.trim(text).startswith("["), F.lit(False)) | F.col("_raw").isNull() | F.col("_list").isNull(), "no_list")
        .when(odd, "unknown_field").when(lost, "wrong_type").when(F.exists("_keys", lambda k: k.isNull()), "no_key")
        .when(F.size(F.array_distinct("_keys")) < F.size("_keys"), "key_twice")
    )
    judged = told.withColumn("reason", reason)
    items = judged.where("reason IS NULL").select(*keys, F.posexplode("_list").alias("position", "_item")).select(*keys, "position", "_item.*")
    return items, judged.select(*keys, F.when(F.col("reason").isNull(), F.size("_list")).alias("n"), "reason")
