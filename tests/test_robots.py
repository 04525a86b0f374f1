"""Robots rules: groups, rule order, wildcards and `$`, against rules applied one by one in Python."""

import re

import pytest

from millrace.operators import robots


def told(spark, text, urls, order, agent="Millrace/2", status="ok"):
    files = spark.createDataFrame([("https://h.example:443", status, text)], "site string, status string, text string")
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, url string")
    return [(r["rule"], r["may_fetch"]) for r in robots.verdicts(rows, "url", files, agent, order).orderBy("k").collect()]


def test_order_of_rules_and_end_marks(spark):
    text = "user-agent: *\nDisallow: /a\nAllow: /a/b\nAllow: /x*y$\nDisallow: /x\nDisallow: /same\nAllow: /same\nDisallow: /*.gif$\n"
    urls = ["https://h.example" + p for p in ("/a", "/a/b", "/x1y", "/x1yz", "/same", "/i/q.gif", "/i/q.gif?x", "", "?q", "/x*y$")]
    assert told(spark, text, urls, "longest") == [(1, False), (2, True), (3, True), (4, False), (6, True), (7, False), (None, True), (None, True), (None, True), (4, False)]
    assert told(spark, text, urls, "first") == [(1, False), (1, False), (4, False), (4, False), (5, False), (None, True), (None, True), (None, True), (None, True), (3, True)]


def test_groups_of_agents(spark):
    text = "Disallow: /\n\nUser-Agent: Mill\n\nDisallow: /blank\nUser-agent: mill\nuser-agent: bot # it\nDisallow: /mill\nUser-agent: *\nDisallow: /star\n\nDisallow: /lost\nUser-agent: millrace\nDisallow: /race"
    urls = ["https://h.example/" + p for p in ("blank", "mill", "star", "lost", "race")]
    assert told(spark, text, urls, "first") == [(None, True), (7, False), (None, True), (None, True), (None, True)]
    assert told(spark, text, urls, "longest") == [(None, True)] * 4 + [(13, False)]
    assert told(spark, text, urls, "longest", "mill") == [(4, False), (7, False), (None, True), (None, True), (None, True)]
    assert told(spark, text, urls, "longest", "else") == [(None, True), (None, True), (9, False), (11, False), (None, True)]
    assert told(spark, text, urls, "first", "else") == [(None, True), (None, True), (9, False), (None, True), (None, True)]


def test_sites_and_urls(spark):
    good = ["https://H.example./x", "https://h.example:443/x", "https://h.example/%78", "HTTPS://h.example/x"]
    assert told(spark, "User-agent: *\nDisallow: /%78", good, "first") == [(1, False)] * 4
    bad = [None, "", "ftp://h.example/x", "https://u:p@h.example/x", "https://h.example:99999/", "nothing", "https:///x"]
    assert told(spark, "User-agent: *\nDisallow: /", bad, "longest") == [(None, False)] * 7
    assert told(spark, None, good[:1], "longest", status="absent") == [(None, True)] and told(spark, None, good[:1], "first", status="failed") == [(None, False)]
    assert told(spark, "", ["https://other.example/x"], "first") == [(None, True)]
    assert told(spark, "User-agent: *\nDisallow:\nDisallow: /x", good[:1], "first") == [(1, True)] and told(spark, "User-agent: *\nDisallow:\nDisallow: /x", good[:1], "longest") == [(2, False)]
    assert told(spark, "User-agent: *\nDisallow: /\\Eé+*", ["https://h.example/\\E%C3%A9+1", "https://h.example/\\Ee"], "longest") == [(1, False), (None, True)]
    with pytest.raises(ValueError):
        told(spark, "", good, "last")


def test_many_rules_against_each_one(spark):
    paths = [f"/{a}/{b}{c}" for a in "abc" for b in ("", "1", "12", "*") for c in ("", "$", "/x", "*z")] + ["/", "*", "/*", "/a*b*c$"]
    rules = [(k + 1, k % 3 != 0, p) for k, p in enumerate(paths)]
    urls = [f"https://h.example/{a}/{b}{c}" for a in "abcd" for b in ("", "1", "12", "9") for c in ("", "/x", "qz", "/x?b=c")]
    text = "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for _, a, p in rules)

    def one(path, order):
        found = []
        for pos, allow, p in rules:
            end = p.endswith("$")
            pattern = ".*".join(map(re.escape, (p[:-1] if end else p).split("*"))) + (r"\Z" if end else "")
            if order == "longest" and re.match(pattern, path) or order == "first" and (p == "*" or path.startswith(p)):
                found.append((-pos,) if order == "first" else (len(p), allow, -pos))
        if not found:
            return None, True
        pos = -max(found)[-1]
        return pos, rules[pos - 1][1]

    for order in ("first", "longest"):
        assert told(spark, text, urls, order) == [one(u.removeprefix("https://h.example"), order) for u in urls]
