import random
from collections import defaultdict, deque
from urllib.parse import urlsplit

import duckdb

from millrace.operators.frontier import crawled, normalized_link
from millrace.plans.registry import QUERIES


def brute(pages, links, seeds, max_depth, max_pages, prefixes):
    """A queue per host, one address at a time."""
    known, out = {}, {}
    for i, url in sorted(pages):
        known.setdefault(normalized_link(url, url), i)
    of = defaultdict(list)
    for i, at, href in sorted(links):
        of[i].append(href)
    queues = defaultdict(deque)
    for _, url in sorted(seeds):
        u = normalized_link(url, url)
        if u and (u, 0) not in queues[urlsplit(u).hostname]:
            queues[urlsplit(u).hostname].append((u, 0))
    for host, queue in queues.items():
        seen, n = {u for u, _ in queue}, 0
        while queue and (max_pages is None or n < max_pages):
            url, depth = queue.popleft()
            n += 1
            out[host, url] = (depth, known.get(url))
            if url not in known or depth >= max_depth:
                continue
            for href in of[known[url]]:
                u = normalized_link(url, href)
                if u is None or urlsplit(u).hostname != host or u in seen:
                    continue
                path = urlsplit(u).path
                if prefixes is not None and not any(path == p or path.startswith(f"{p}/") for p in prefixes):
                    continue
                seen.add(u)
                queue.append((u, depth + 1))
    return out


def test_against_a_queue(spark):
    rng = random.Random(1)
    paths = ["/", *[f"/a/{i}" for i in range(12)], *[f"/b/{i}" for i in range(6)]]
    pages = [(i, f"https://{h}{p}") for i, (h, p) in enumerate((h, p) for h in ("x.example", "y.example") for p in paths)]
    hrefs = [*paths, "3", "../b/1", "#top", "?q=1", "https://x.example/a/2/", "https://y.example:443/a/4", "//x.example/b/5", "mailto:a@b", "https://u@x.example/", "HTTP://Y.example/a/1", "/none", "http://[", "/ab"]
    links = [(i, k, rng.choice(hrefs)) for i, _ in pages for k in range(5)]
    seeds = [(0, "https://x.example/"), (1, "https://y.example/a/0"), (2, "https://X.example/b/0/"), (3, "https://x.example")]
    p = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    x = spark.createDataFrame(links, "page_id long, at int, href string").repartition(3)
    s = spark.createDataFrame(seeds, "at long, url string")
    deepest = 0
    for bounds in ((3, 7, None), (2, 20, ["/a"]), (4, None, ["/a", "/b"])):
        want = brute(pages, links, seeds, *bounds)
        got = crawled(p, x, s, *bounds).collect()
        assert len(got) == len(want) and {(r["host"], r["url"]): (r["depth"], r["page_id"]) for r in got} == want
        deepest = max(deepest, *(r["depth"] for r in got))
    assert deepest >= 3


def test_every_page_is_crawled(spark):
    d = "/root/testdata/sf0.001"
    pages = duckdb.sql(f"SELECT page_id, url FROM '{d}/pages.parquet'").fetchall()
    links = duckdb.sql(f"SELECT page_id, generate_subscripts(h, 1) AS at, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM '{d}/pages.parquet')").fetchall()
    want = brute(pages, links, pages, 1, None, None)
    got = {(r["host"], r["url"]): (r["depth"], r["page_id"]) for r in QUERIES["site_frontier"](spark, d).collect()}
    assert got == want
    # of pages with one address the first one is read; no address is left out
    assert {u for _, u in got} >= {normalized_link(u, u) for _, u in pages if normalized_link(u, u)}
