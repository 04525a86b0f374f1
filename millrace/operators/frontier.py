"""A bounded breadth-first crawl of sites, over tables of pages and links instead of a network."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut


def normalized_link(base: str | None, link: str | None) -> str | None:
    """The link of a page as an address to fetch: http(s) without user, default port, closing slashes and fragment; null if none."""
    if base is None or link is None:
        return None
    try:
        parsed = urlsplit(urljoin(base, link))
        port = parsed.port
    except ValueError:
        return None
    if parsed.scheme not in ("http", "https") or parsed.hostname is None or parsed.username is not None:
        return None
    host = parsed.hostname.lower().rstrip(".")
    shown = f"[{host}]" if ":" in host else host
    netloc = shown if port is None or (parsed.scheme, port) in (("http", 80), ("https", 443)) else f"{shown}:{port}"
    return urlunsplit((parsed.scheme, netloc, parsed.path.rstrip("/") or "/", parsed.query, ""))


def _resolved(base: pd.Series, link: pd.Series) -> pd.DataFrame:
    urls = [normalized_link(b, x) for b, x in zip(base, link, strict=True)]
    parts = [None if u is None else urlsplit(u) for u in urls]
    return pd.DataFrame({"url": urls, "host": [p and p.hostname for p in parts], "path": [p and p.path for p in parts]}, dtype=object)


def resolved(base: Column, link: Column) -> Column:
    """Struct (url, host, path)."""
    return F.pandas_udf(_resolved, "struct<url:string,host:string,path:string>")(base, link)


def crawled(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_depth: int = 1, max_pages: int | None = 10, prefixes: Sequence[str] | None = ("/about", "/jobs", "/careers")) -> DataFrame:
    """(host, url, depth, page_id) of each address fetched; page_id is null where pages has no such address.

    pages: page_id, url. links: page_id, at (place on its page), href. seeds: at (order), url. A round takes the addresses found by the one
    before in the order found, up to max_pages of a host over all rounds (those that fail count too; None: no bound); of the pages fetched at less than
    max_depth it follows the links to the same host whose path is one of prefixes or below one (None: any path) and that haven't been seen."""

    def eligible(path: Column) -> Column:
        if prefixes is None:
            return F.lit(True)
        return F.coalesce(*[F.when((path == p) | path.startswith(f"{p}/"), True) for p in prefixes], F.lit(False))

    known = _cut(pages.select("page_id", resolved(F.col("url"), F.col("url"))["url"].alias("url")).where("url IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("page_id")))
    start = seeds.select(resolved(F.col("url"), F.col("url")).alias("r"), F.array(F.col("at").cast("long")).alias("at"))
    found = start.select("r.host", "r.url", "at").where("url IS NOT NULL").groupBy("host", "url").agg(F.min("at").alias("at"))
    seen, fetched, depth = None, None, 0
    while True:
        found = _cut(found)
        if found.isEmpty():
            return fetched if fetched is not None else found.select("host", "url", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("page_id"))
        seen = found.select("host", "url") if seen is None else _cut(seen.unionByName(found.select("host", "url")))
        now = found
        if max_pages is not None:
            before = fetched.groupBy("host").agg(F.count("*").alias("before")) if fetched is not None else found.select("host").distinct().withColumn("before", F.lit(0))
            ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("at")))
            # the place in the order is all that the next round needs of it
            now = ranked.join(before, "host", "left").where(F.col("n") + F.coalesce("before", F.lit(0)) <= max_pages).select("host", "url", F.array(F.col("n").cast("long")).alias("at"))
        now = _cut(now.join(known, "url", "left").select("host", "url", "at", F.lit(depth).alias("depth"), "page_id"))
        rows = now.select("host", "url", "depth", "page_id")
        fetched = rows if fetched is None else fetched.unionByName(rows)
        if depth >= max_depth:
            return fetched
        own = now.where("page_id IS NOT NULL").select("host", "page_id", "at", F.col("url").alias("base"))
        out = own.join(links.select("page_id", F.col("at").alias("place"), "href"), "page_id").select("host", F.concat("at", F.array(F.col("place").cast("long"))).alias("at"), resolved(F.col("base"), F.col("href")).alias("r"))
        same = out.where((F.col("r.host") == F.col("host")) & eligible(F.col("r.path"))).groupBy("host", F.col("r.url").alias("url")).agg(F.min("at").alias("at"))
        found = same.join(seen, ["host", "url"], "left_anti")
        depth += 1
