"""Job cards by platform against a walk of a tree that is built first, and selectors one by one."""

from html.parser import HTMLParser

import pytest

from millrace.functions import cards, jobs, selectors
from millrace.plans import collection, registry
from millrace.plans.base import Tables

SF = "/root/testdata/sf0.01"


class Node:
    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.up, self.kids = tag, {k: v or "" for k, v in attrs}, up, []


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.root = self.at = Node("", [], None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.at)
        self.at.kids.append(node)
        if tag not in selectors.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, attrs, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None and tag not in selectors.VOID:
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(data)


def walk(node):
    for kid in node.kids:
        if isinstance(kid, Node):
            yield kid
            yield from walk(kid)


def one(node, word):
    """A compound by hand: tag.class[attr op value]."""
    for tag, cls, attr, op, a, b in __import__("re").findall(r"([\w*]+)|\.([\w-]+)|\[([\w-]+)(?:([*^$]?=)(?:'([^']*)'|(\w+)))?\]", word):
        if tag and tag not in ("*", node.tag) or cls and cls not in node.attrs.get("class", "").split():
            return False
        if attr and (attr not in node.attrs or op == "*=" and (a or b) not in node.attrs[attr] or op == "=" and (a or b) != node.attrs[attr]):
            return False
    return True


def matches(node, group):
    def chain(node, words):
        if not one(node, words[-1]):
            return False
        if len(words) == 1:
            return True
        above, direct = node.up, words[-2] == ">"
        rest = words[:-2] if direct else words[:-1]
        while above is not None and above.up is not None:
            if chain(above, rest):
                return True
            if direct:
                return False
            above = above.up
        return False

    return any(chain(node, x.split()) for x in group.split(", "))


def first(node, group):
    return next((x for x in walk(node) if matches(x, group)), None)


def text(node, between=""):
    def strings(n):
        for kid in n.kids:
            if isinstance(kid, Node):
                yield from strings(kid) if kid.tag not in selectors.MUTE else ()
            elif kid.strip():
                yield kid.strip()

    return between.join(strings(node)) if node else ""


def brute(html, platform):
    rules, out, seen = cards.PLATFORMS.get(platform, cards.PLATFORMS["generic"]), [], set()
    for card in walk(Tree(html or "").root):
        if not matches(card, rules.cards):
            continue
        link = card if card.tag == "a" else first(card, rules.link)
        href = link.attrs.get("href", "").strip() if link else ""
        if not href or href in seen:
            continue
        seen.add(href)
        found = [text(first(card, s)) for s in rules.titles]
        title = next((x for x in found if x), None) or text(next((x for s in cards.LINK_TITLES if (x := first(link, s))), link))
        if not title:
            continue
        named = {k: text(first(card, s), " ") for k, s in rules.attributes.items()}
        blob = " | ".join([title[:500], *filter(None, named.values()), text(card, " ")[:1000]] if rules.rich else [title[:500]])
        low, high, months = jobs.card_salary(blob)
        out.append((len(out), title[:500], href, blob, low, high, months, {k: named[k] for k in named}))
    return out


def plain(rows):
    return [(*r[:2], r[2].removeprefix("https://example.com"), *r[3:7], {k: v for k, v in r[7].items() if not k.startswith("salary_m")}) for r in rows]


@pytest.mark.parametrize("platform", [*cards.PLATFORMS, "unknown"])
def test_cards_equal_a_walk_of_the_tree(spark, platform):
    pages = [r["html"] for r in collection.platform_pages(Tables(spark, SF)).where("platform = 'lagou'" if platform == "unknown" else f"platform = '{platform}'").collect()]
    assert len(pages) == 250
    rows = [plain(cards.listed(p, platform)) for p in pages]
    assert rows == [brute(p, platform) for p in pages]
    assert platform == "unknown" or sum(map(len, rows)) > 250


@pytest.mark.parametrize("platform", list(cards.PLATFORMS))
@pytest.mark.parametrize("html", [
    "<ul class=job-list><li class=con_list_item><h3 class=position-name><a href=/jobs/1>Dev <b>Ops</b></a></h3><span class=money>15-25K</span><li><a class=position_link href=/jobs/2>Two</ul>",
    "<div class='job-card job-item'><div class='job-card job-item'><a href=/a>in</a></div><a href=/b>out</a></div></div></p><li class='job-item'><a href=/c><script>x</script><i class='sub-title-x'>t</i>rest",
    "<div class=search-result-list><p><div class=job-item><h3><a href=/job/1>A</a></h3><br><img class=area><h4></h4><span class=title>B</span></div></div><section class=job-list-view><section>no</section></section>",
    "<div class=job-list-view><section><a class=job-title href=//h.example/1>x</a></section><div><section><a class=job-title href=/2>y</a></section></div></div>",
    "<a class='job-card link-abc positionItem' href=' /x '><b class=positionItem-title-text></b>text</a><a class=job-card href=/x>again</a><a class=job-card>none</a>",
    "<!-- <li class=job-item> --><LI CLASS=job-item><A HREF=/up>Up &amp; away</A></LI><li class=job-item data-job-id><a href='http://[bad'>bad</a>", "   ", "", "<", "<li class=job-item",
])
def test_nested_and_unclosed_cards(platform, html):
    got = plain(cards.listed(html, platform))
    want = [(*w[:2], w[2] if not w[2].startswith("//") else f"https:{w[2]}", *w[3:]) for w in brute(html, platform)]
    want = [w for w in want if "[bad" not in w[2]]
    assert [(*g[:2], g[2].strip(), *g[3:]) for g in got] == [(n, *w[1:]) for n, w in enumerate(want)]


def test_selectors():
    def found(group, html):
        class Ids(selectors.Reader):
            def opens(self, element, names):
                if names:
                    out.append(element.attrs.get("id"))

        out: list = []
        Ids(selectors.Matcher({"x": group})).read(html)
        return out

    html = "<div id=a class='x y'><p id=b><span id=c data-k='v,w'></span></p><div id=d><p id=e class=y></p></div></div><p id=f title='a > b'>"
    assert found("p", html) == ["b", "e", "f"]
    assert found("div > p", html) == ["b", "e"]
    assert found("div div p, span", html) == ["c", "e"]
    assert found(".x.y", html) == ["a"] and found(".y", html) == ["a", "e"]
    assert found("[data-k='v,w']", html) == ["c"] and found('p[title="a > b"]', html) == ["f"]
    assert found("[data-k^=v], [title$=b]", html) == ["c", "f"] and found("[title*='']", html) == []
    assert found("#d>*", html) == ["e"] and found("div *", html) == ["b", "c", "d", "e"]
    for bad in ("p:first-child", "p >", "", "p + p"):
        with pytest.raises(ValueError):
            selectors.compiled(bad)


def test_queries_and_sql(spark):
    rows = registry.QUERIES["platform_jobs"](spark, SF)
    status = registry.QUERIES["platform_list_status"](spark, SF)
    by = {(r["page_id"], r["platform"]): r["observed"] for r in status.collect()}
    got = {(r["page_id"], r["platform"]): r["count"] for r in rows.groupBy("page_id", "platform").count().collect()}
    assert len(by) == 1500 and {k: v for k, v in by.items() if v} == got
    lagou = rows.where("platform = 'lagou'").first()
    assert (lagou["city"], lagou["low"], lagou["high"]) == ("上海", 15, 25)
    spark.udtf.register("job_cards", cards.job_cards())
    spark.createDataFrame([(1, "<div class=job-card><a href=/q>Q</a></div>"), (2, None)], "id int, html string").createOrReplaceTempView("lists")
    assert [tuple(r) for r in spark.sql("SELECT id, title, url FROM lists, LATERAL job_cards(html, 'feishu', 'https://jobs.example')").collect()] == [(1, "Q", "https://jobs.example/q")]
    odd = spark.createDataFrame([(1, None, "feishu"), (2, " \n", "moka"), (3, "<p>", None)], "id int, html string, platform string")
    assert [r["status"] for r in cards.list_status(odd, "html", "platform").orderBy("id").collect()] == ["failed", "failed", "partial"]
