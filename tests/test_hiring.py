"""Recruiting sites: cases beyond those of the queries."""

import random

from pyspark.sql import functions as F

from millrace.operators import hiring as H
from millrace.operators import windows as W


def test_identities(spark):
    cases = {
        None: (None, False), "": (None, True), "https://jobs.lever.co./Acme/1?x=2": ("tenant:jobs.lever.co:Acme", False), "https://apply.workable.com/j/": (None, True), "https://apply.workable.com/acme/j/1": ("tenant:apply.workable.com:acme", False),
        "https://boards.greenhouse.io/embed/job_app?for=%2D&for=ok": ("tenant:boards.greenhouse.io:ok", False), "https://wd1.myworkdaysite.com/other/x": (None, True), "https://careers.example.org/": ("url:https://careers.example.org/", False),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", H.recruitment_identity(F.col("u")).alias("r"))
    assert {r["u"]: tuple(r["r"]) for r in df.collect()} == cases


def test_persisted(spark):
    jobs = spark.createDataFrame([(1, "a", "dev", "x"), (2, "b", "ops", "")], "job_id int, company string, title string, city string")
    sources = spark.createDataFrame([("p", "1", 1), ("p", "2", 2)], "provider string, raw_id string, job_id int")
    new = [(1, "a", "p", "1", "t", ""), (2, "a", "p", "2", "t", ""), (3, "a", "p", "3", "dev", "x"), (4, "a", "p", "4", "dev", "y"), (5, "a", "p", "5", "dev", "y")]
    rows = H.persisted(spark.createDataFrame(new, "row_id int, company string, provider string, raw_id string, title string, city string"), sources, jobs).collect()
    assert {r["row_id"]: (r["action"], r["job_id"]) for r in rows} == {1: ("refreshed", 1), 2: ("conflict", 2), 3: ("source_added", 1), 4: ("job_created", None), 5: ("source_added", None)}


def one_by_one(candidates, sources, jobs):
    """The rule as it is told: candidates in order, each against what is there by then."""
    known = {(p, r): j for p, r, j in sources}
    owner = {j: c for j, c, _, _ in jobs}
    by_name, out, made = {}, {}, {}
    for j, c, t, city in sorted(jobs):
        by_name.setdefault((c, t, city or ""), j)
    for row, c, p, r, t, city in sorted(candidates):
        if p is not None and r is not None and (p, r) in known:
            job = known[p, r]
            out[row] = ("refreshed" if owner[job] == c else "conflict", job if isinstance(job, int) else None, made.get(job))
            continue
        job, action = by_name.get((c, t, city or "")), "source_added"
        if job is None:
            job, action = f"new{row}", "job_created"
            by_name[c, t, city or ""], owner[job], made[job] = job, c, row
        if p is not None and r is not None:
            known[p, r] = job
        out[row] = (action, job if isinstance(job, int) else None, made.get(job))
    return out


def test_persisted_within_one_batch(spark):
    """Raw ids that repeat in the batch, for one company or two; null cities, null raw ids."""
    rng = random.Random(9)
    jobs = [(j, rng.choice("ab"), rng.choice(["dev", "ops"]), rng.choice(["x", "", None])) for j in range(1, 7)]
    sources = [("p", f"s{j}", j) for j in range(1, 5)]
    new = [(n, rng.choice("abc"), "p", rng.choice(["s1", "s3", None, *(f"n{k}" for k in range(20))]), rng.choice(["dev", "ops", "qa"]), rng.choice(["x", "y", "", None])) for n in range(1, 120)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = H.persisted(frame(new, "row_id int, company string, provider string, raw_id string, title string, city string"), frame(sources, "provider string, raw_id string, job_id int"), frame(jobs, "job_id int, company string, title string, city string")).collect()
    got = {r["row_id"]: (r["action"], r["job_id"], r["made_by"]) for r in rows}
    assert len(rows) == len(new) and got == one_by_one(new, sources, jobs)
    assert {a for a, _, _ in got.values()} == {"refreshed", "conflict", "source_added", "job_created"}


def test_truncation_and_stages(spark):
    rows = spark.createDataFrame([("c", "low", str(i), f"f{i}") for i in range(3)] + [("d", "high", "9", "f9")], "code string, severity string, subject string, finding_id string")
    assert [r["code"] for r in H.ordered_findings(rows, ["high", "low"], 2).orderBy("place").collect()] == ["d", "c", "truncated"]
    assert H.ordered_findings(rows, ["high", "low"], 4).count() == 4 and H.ordered_findings(rows.where("false"), ["high"], 4).count() == 0
    signals = spark.createDataFrame([(1, "A轮", None, 1), (1, "Pre-A", "2020-01-01", 2), (1, "unknown", "2021-01-01", 3), (2, "x", None, 4)], "id int, label string, day string, n int")
    assert {r["id"]: r["stage"] for r in H.latest_stage(signals.withColumn("day", F.to_date("day")), "id", "label", "day", "n").collect()} == {1: "pre_a", 2: "unknown"}


def test_no_single_task(spark):
    """Ranks, percentiles and buckets over large groups don't gather rows in one partition."""
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    assert sorted(r["p"] for r in W.dense_positions(df, ["v"], "p").collect()) == list(range(1000))
    within = W.dense_positions(df, ["v"], "p", ["g"])
    assert within.where("p <> v div 7").count() == 0
    shares = W.with_midrank(df, "v", ["g"], "m").where("v = 7").first()["m"]
    assert abs(shares - 1.5 / 143) < 1e-9
    assert W.with_bucket(df, 5, ["v"], "b").where("b <> floor(v * 5 / 1000)").count() == 0
