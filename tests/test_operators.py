import random
from datetime import date, datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.functions import html as H
from millrace.functions import jobs as J
from millrace.functions import similarity as S
from millrace.operators import coverage, graph, lifecycle, merge, ranking, relational, resolve, windows
from millrace.sources import readers, sinks


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_coverage_needs_every_entry(spark):
    entries = spark.createDataFrame([("a", "a1", True), ("a", "a2", True), ("b", "b1", True), ("b", "b2", True), ("c", "c1", True), ("d", "d1", False)], "owner string, entry string, active boolean")
    t = datetime(2024, 1, 29, 12)
    shots = [("a1", t, 1, True), ("a2", t, 2, True), ("b1", t, 3, True), ("c1", t, 4, True), ("c1", t, 5, False), ("c1", t - timedelta(days=9), 6, True)]
    snaps = spark.createDataFrame([(e, at, at, i, True, True, empty) for e, at, i, empty in shots], "entry string, at timestamp_ntz, created timestamp_ntz, id long, succeeded boolean, complete boolean, empty boolean")
    r = coverage.coverage_report(entries, snaps, "2024-01-30 00:00:00", 24).collect()[0]
    assert (r["target"], r["active"], r["enumerated"], r["confirmed_empty"], r["entries_enumerated"]) == (4, 3, 3, 1, 4)
    assert (r["entry_rate"], r["empty_rate"]) == (0.75, 0.3333)
    none = coverage.coverage_report(entries.where("false"), snaps, "2024-01-30 00:00:00", 24).collect()[0]
    assert none["target"] == 0 and none["entry_rate"] is None
    with pytest.raises(ValueError):
        coverage.window_start("2024-01-30 00:00:00", 0)


def test_midrank_percentile(spark):
    rng = random.Random(1)
    data = [(g, rng.randint(0, 6)) for g in "aaaaaaaaaaaaaaaabbbbbbbc" for _ in range(2)] + [("d", 3), ("e", 0)]
    got = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "i int, g string, v int")
    got = windows.with_midrank(got, "v", ["g"], "p").select("i", "p").collect()
    for r in got:
        g, v = data[r["i"]]
        peers = [x for h, x in data if h == g]
        want = 0.0 if v <= 0 else 1.0 if len(peers) == 1 else (sum(x < v for x in peers) + sum(x == v for x in peers) / 2) / len(peers)
        assert abs(r["p"] - want) < 1e-12


def test_apportionment(spark):
    rng = random.Random(2)
    for seats in (1, 7, 50):
        counts = {f"s{i}": rng.randint(1, 40) for i in range(9)}
        total = sum(counts.values())
        base = {k: n * seats // total for k, n in counts.items()}
        order = sorted(counts, key=lambda k: (-(counts[k] * seats % total), k))
        want = {k: base[k] + (k in order[: seats - sum(base.values())]) for k in counts}
        df = spark.createDataFrame(list(counts.items()), "stratum string, n long")
        assert dict(rows(windows.largest_remainder(df, "n", seats, ["stratum"]), "stratum", "seats")) == want
        split = windows.floor_and_share(df, "n", seats).collect()
        assert sum(r["seats"] for r in split) == seats


def test_positions_and_buckets(spark):
    df = spark.createDataFrame([((i * 37) % 101,) for i in range(101)], "v int").repartition(5)
    assert rows(windows.dense_positions(df, ["v"], "place"), "v", "place") == [(i, i) for i in range(101)]
    assert rows(windows.with_bucket(df.select("v"), 5, ["v"], "b"), "v", "b") == [(i, i * 5 // 101) for i in range(101)]
    sample = windows.stratified_sample(df, F.concat(F.lit("s"), (F.col("v") % 3).cast("string")), "v", 20, "x")
    assert sample.count() == 20 and rows(sample, "v") == rows(windows.stratified_sample(df, F.concat(F.lit("s"), (F.col("v") % 3).cast("string")), "v", 20, "x"), "v") != rows(windows.stratified_sample(df, F.concat(F.lit("s"), (F.col("v") % 3).cast("string")), "v", 20, "y"), "v")


def test_lifecycle_rules(spark):
    seen = [True, False, False, True, False]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(seen)], "k int, at int, seen boolean")
    got = rows(lifecycle.absence(df, "k", ["at"], F.col("seen"), F.lit(True)), "at", "missing", "active")
    assert got == [(0, 0, True), (1, 1, True), (2, 2, False), (3, 0, True), (4, 1, True)]
    partial = rows(lifecycle.absence(df, "k", ["at"], F.col("seen"), F.col("at") != 1), "at", "missing", "active")
    assert partial == [(0, 0, True), (2, 1, True), (3, 0, True), (4, 1, True)]
    runs = spark.createDataFrame([("a", "r", "x", 1), ("a", "r", "x", 2), ("a", "r", "y", 3)], "e string, r string, digest string, at int")
    assert [r[1] for r in rows(lifecycle.replays(runs, ["e", "r"], "digest", ["at"]), "at", "outcome")] == ["applied", "replayed", "conflict"]


def test_ranking_rules(spark):
    day = date(2020, 1, 1)
    df = spark.createDataFrame([(1, None, 5), (2, day - timedelta(days=100), 5), (3, day - timedelta(days=100), 500), (4, day - timedelta(days=4000), 5), (5, day - timedelta(days=2000), 50)], "i int, founded date, staff int")
    staged = df.withColumn("stage", ranking.stage(F.col("founded"), F.col("staff"), F.lit(day)))
    assert [r[1] for r in rows(staged, "i", "stage")] == ["growth", "early", "mature", "mature", "growth"]
    assert {r[1] for r in rows(ranking.merge_small_stages(staged), "i", "stage")} == {"growth"}
    scored = spark.createDataFrame([("e", 5), ("e", 1), ("m", 100), ("m", 120), ("z", 0)], "stage string, a int")
    done = rows(ranking.calibrated(scored, "stage", {"a": 30}), "stage", "a", "total")
    assert done == [("e", 8, 8), ("e", 22, 22), ("m", 8, 8), ("m", 22, 22), ("z", 0, 0)]


def test_search_and_paging(spark):
    names = spark.createDataFrame([(1, "ai"), (2, "other"), (3, "aix"), (4, "b"), (5, "xai"), (6, "c"), (7, "z")], "id int, name string")
    aliases = spark.createDataFrame([(2, "ai"), (4, "aia"), (6, "bai")], "owner int, alias string")
    assert rows(relational.search(names, aliases, "ai", "id", "name", "owner", "alias"), "id", "tier") == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)]
    for bad in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            relational.page_bounds(*bad)
    with pytest.raises(ValueError):
        relational.matching(names, nothing=1)
    assert relational.fingerprint(spark.createDataFrame([(1,), (1,)], "i int"), "i").collect()[0]["fingerprint"] is None


def test_components_and_groups(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a int, b int")
    got = dict(rows(graph.connected_components(edges), "id", "component"))
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}
    people = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", None)], "id int, n string, m string")
    assert dict(rows(graph.grouped_by_shared_keys(people, "id", ["n", "m"]), "id", "component")) == {1: 1, 2: 1, 3: 1, 4: 4}


def test_merge_rules(spark):
    stored = spark.createDataFrame([(1, "a", "long text", 5), (2, None, "x", 3)], "k int, a string, b string, c int")
    new = spark.createDataFrame([(1, None, "short", 4), (3, "n", None, 1)], "k int, a string, b string, c int")
    got = merge.merged(stored, new, ["k"], {"a": "fill", "b": "longer", "c": "earliest"})
    assert rows(got, "k", "a", "b", "c", "change") == [(1, "a", "long text", 4, "updated"), (2, None, "x", 3, "unchanged"), (3, "n", None, 1, "created")]
    again = merge.merged(got.drop("change"), new, ["k"], {"a": "fill", "b": "longer", "c": "earliest"})
    assert {r["change"] for r in again.collect()} == {"unchanged"}
    with pytest.raises(ValueError):
        merge.merged(stored, new, ["k"], {"a": "guess"})


def test_similarity(spark):
    rng = random.Random(3)

    def table(a, b):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        return n[-1][-1]

    pairs = [("".join(rng.choice("abc é") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abc é") for _ in range(rng.randint(0, 12)))) for _ in range(100)] + [("x", None)]
    assert all(S.common_subsequence(a, b) == table(a, b) for a, b in pairs[:-1])
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", S.ratio("a", "b"), S.title_ratio("a", "b"), S.partial_ratio("a", "b")).collect()
    for i, r, t, p in got:
        a, b = pairs[i]
        if b is None:
            assert r is None and t is None and p is None
        else:
            assert abs(r - (200 * table(a, b) / (len(a) + len(b)) if a or b else 100)) < 1e-9 and p >= r - 1e-9 or min(len(a), len(b)) == 0
            assert abs(t - SequenceMatcher(None, a, b, autojunk=False).ratio() * 100) < 1e-9
    assert S.fold(" Ｓtraße　X ") == "strassex"
    near = resolve.trigram_neighbours(df.select(F.col("i").alias("id"), F.col("a").alias("name")), df.select(F.col("i").alias("id"), F.col("a").alias("name")), 3)
    assert near.groupBy("a").count().where("count > 3").count() == 0


def test_salaries(spark):
    cases = {"15-25K·14薪": (15000, 25000, 14, None), "1.5-2.5K": (1500, 2500, None, None), "25-15K": (None, None, None, "invalid_salary"), "1.00005-2K": (None, None, None, "invalid_salary"), "1-2K·99999薪": (None, None, None, "invalid_salary"), "1-99999999K": (None, None, None, "invalid_salary"), "negotiable": (None, None, None, "invalid_salary"), "8k-9k": (8000, 9000, None, None)}
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "t string").select("t", C.salary(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] and tuple(r["s"]) for r in df.collect()} == {**cases, None: None}
    cards = {
        "15-25K": (15, 25, None), "15-25k·16薪": (15, 25, 16), "1.5-2.5万": (15, 25, None), "1-2w": (10, 20, None), "8千-1.2万": (None, None, None), "150-200/天": (None, None, None), "30-60万/年": (None, None, None), "25-50": (None, None, None),
        "8000-12000元": (None, None, None), "3-5年经验": (None, None, None), "3-5年经验 20-30K": (20, 30, None), "面议 14薪": (None, None, 14), "25-15K·13薪": (None, None, 13), "60-70万": (None, None, None), "12.5-13.5k": (12, 14, None), "": (None, None, None), None: (None, None, None),
    }
    assert {c: J.card_salary(c) for c in cards} == cards
    got = spark.createDataFrame([(c,) for c in cards], "c string").select("c", J.salary("c").alias("s")).collect()
    assert {r["c"]: tuple(r["s"]) for r in got} == cards


def test_urls(spark):
    cases = {
        "HTTP://User.Example.COM:80/a?utm_source=x&b=1#f": ("http://user.example.com/a?utm_source=x&b=1", "http://user.example.com/a", "http://user.example.com/a?b=1", "example.com"),
        "https://shop.example.co.uk/": ("https://shop.example.co.uk/", "https://shop.example.co.uk/", "https://shop.example.co.uk", "example.co.uk"),
        "https://h.example.com:8443/x": ("https://h.example.com:8443/x", "https://h.example.com:8443/x", "https://h.example.com:8443/x", "example.com"),
        "ftp://a.b/": (None, None, None, "a.b"), "https://user:pw@a.b/": (None, None, None, ""), "nonsense": (None, None, None, ""),
    }
    u = F.col("u")
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", C.normalized_url(u), C.identity_url(u), C.entry_url(u), C.root_domain(u)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == cases
    public = spark.createDataFrame([("http://10.0.0.1/",), ("http://localhost/",), ("http://a.local/",), ("http://a.com/",)], "u string").select(C.statically_public(u)).collect()
    assert [r[0] for r in public] == [False, False, False, True]


def test_html_and_cards():
    text, title, links = H.read("<html><head><title> A  b</title><script>no()</script></head><body><p>One<br>two &amp; <a href='/x'>three  four</a></p><style>p{}</style></body>")
    assert (text, title, links) == ("One two & three four", "A b", [("/x", "three four")])
    page = "<ul><li><a href='/1'>Dev</a><span>15-25K·14薪</span></li><li><a href='/1'>again</a></li><li><a href='/2'>Ops <b>x</b></a></li></ul><a href='/3'>Lone</a>"
    assert [(j["title"], j["url"], j["low"], j["months"]) for j in J.listed(page)] == [("Dev", "/1", 15.0, 14), ("Ops x", "/2", None, None), ("Lone", "/3", None, None)]


def test_names_without_endings(spark):
    bare = {"北京月之暗面科技有限公司": "月之暗面", "广东省深圳市（星辰）集团公司": "星辰", "上海市": "市", "公司": "公司", " 星辰责任公司 ": "星辰责任", "中国·星辰网络科技（集团）有限公司": "星辰网络", "Acme Ltd": "Acme Ltd", "深圳星辰控股-集团": "星辰", "": ""}
    search = {"北京 百川智能科技有限公司": ["北京百川智能科技有限公司", "百川智能科技有限公司", "百川智能", "百川智"], "Acme": ["Acme"], "上海数智": ["上海数智"], "深圳星辰": ["深圳星辰"], "  ": []}
    df = spark.createDataFrame([(n,) for n in [*bare, *search]], "n string").select("n", J.without_legal_suffixes(F.col("n")).alias("b"), J.variants(F.col("n")).alias("v"))
    got = {r["n"]: (r["b"], r["v"]) for r in df.collect()}
    assert {n: got[n][0] for n in bare} == bare and {n: got[n][1] for n in search} == search
    places = spark.createDataFrame([("驻乌鲁木齐/南京",), ("remote job",), ("Remote",), ("nowhere",), ("南京或上海",)], "t string").select(J.city(F.col("t"))).collect()
    assert [r[0] for r in places] == ["乌鲁木齐", "远程", "远程", None, "上海"]


def test_job_types(spark):
    df = spark.createDataFrame([("校招 工程师", "experienced"), ("Intern", "campus"), ("外包 Dev", "campus"), ("Dev", "internship")], "title string, kind string")
    got = df.select(J.public_type(F.col("title"), F.col("kind")), J.ranking_type(F.col("title"), F.col("kind")), J.employment_type(F.col("title"))).collect()
    assert [tuple(r) for r in got] == [("internship", "campus", "full_time"), ("internship", "internship", "internship"), ("campus", "campus", "temporary"), ("internship", "internship", None)]


def test_readers(spark, tmp_path):
    (tmp_path / "seed.json").write_text('{"version": 1, "companies": [{"canonical_name": "A", "aliases": ["a", "aa"], "jobs": [{"title": "T", "sources": [{"provider": "p", "source_raw_id": "1"}]}]}]}')
    got = readers.seed(spark, f"file://{tmp_path}/seed.json")
    assert {k: v.count() for k, v in got.items()} == {"companies": 1, "aliases": 2, "jobs": 1, "sources": 1}
    good, bad = ('{"id": "%d", "name": "n", "url": "u"}' % 1), '{"id": "", "name": "n"}'
    bodies = spark.createDataFrame([(1, f"[{good}]"), (2, f'{{"items": [{good}, {good}, {good}, {good}, {bad}], "has_more": false}}'), (3, f'{{"data": [{good}, {bad}]}}'), (4, "broken")], "k int, body string")
    jobs, verdict = readers.external_jobs(bodies)
    assert rows(verdict, "k", "complete", "n", "rejected", "failed") == [(1, True, 1, 0, False), (2, True, 5, 1, False), (3, False, 2, 1, True), (4, False, 0, 0, False)] and jobs.count() == 6
    book = spark.createDataFrame([(1, "A", "open"), (2, "A", "open"), (3, " - ", "open"), (4, "B", "shut")], "row int, name string, status string")
    assert rows(readers.candidates(book, ["name", "status", "row"], "name", "status", "open", "row"), "row") == [(1,)]
    with pytest.raises(ValueError):
        readers.candidates(book, ["absent"], "name", "status", "open", "row")
    pairs = spark.createDataFrame([("A", "s1"), ("B", "s2"), ("C", "s3"), ("D", "s3"), ("E", "s5")], "name string, site string")
    companies = spark.createDataFrame([("A", 1), ("B", 2), ("B", 3), ("C", 4), ("D", 5)], "name string, id int")
    ok, rejected = readers.site_mapping(pairs, companies)
    assert rows(ok, "name", "id") == [("A", 1)] and rows(rejected, "name", "reason") == [("B", "ambiguous_name"), ("C", "site_twice"), ("D", "site_twice"), ("E", "unknown_name")]
    sinks.append(companies, f"file://{tmp_path}/t")
    sinks.append_new(companies.unionByName(spark.createDataFrame([("Z", 9)], companies.schema)), f"file://{tmp_path}/t", ["name", "id"])
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 6
    assert companies.limit(1).select(sinks.canonical_json("name", "id")).collect()[0][0] == '{"id":1,"name":"A"}'


def test_decision_table(spark):
    cases = [(2, False, True, 0, False), (1, False, True, 0, False), (1, True, True, 0, False), (0, False, False, 0, False), (0, False, True, 1, True), (0, False, True, 0, False)]
    kind, reasons = resolve.decision(*[F.col(c) for c in "abcde"])
    got = spark.createDataFrame(cases, "a int, b boolean, c boolean, d int, e boolean").select(kind, F.array_join(reasons, ",")).collect()
    assert [tuple(r) for r in got] == [("review", "ambiguous_owner"), ("existing", ""), ("review", "conflicting_evidence"), ("review", "similarity_unavailable"), ("review", "short_name,similar_name"), ("new", "")]
