"""Rows of job list pages by platform: selectors for cards, links, titles and further attributes, in one pass over the page."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import jobs
from .selectors import Element, Matcher, Reader


@dataclass(frozen=True)
class Rules:
    """Where a platform's pages have what. titles are tried in order, each by its first element in the card; attributes are
    named. A rich platform's city, kind and salary are also inferred from the attributes and the card's text."""

    cards: str
    link: str
    titles: tuple[str, ...] = (".job-title", ".position-name", "h3", "h4")
    attributes: dict[str, str] = field(default_factory=dict)
    rich: bool = False


#: Selectors of the platforms (fixed values).
PLATFORMS = {
    "feishu": Rules(".positionItem, div.job-card, li.job-item, [data-job-id]", "a"),
    "moka": Rules("a.link-abc, .link-abc, div.position-list-item, li.position-item, [data-position-id]", "a"),
    "liepin": Rules(
        "div.sojob-item, div.job-list-item, div.search-result-list div.job-item, li.job-list-item, .job-list-view > section, div[data-position-id]",
        "a.job-title, h3.job-title a, a[href*='/job/'], a[href*='liepin.com/job']",
        (".job-title", "h3.job-title", "span.title", "h3 a", "h4", ".title"),
        {
            "salary": ".job-salary, .text-warning, [class*='salary'], span.compensate", "city": ".job-area, .area, [class*='area'], span.ellipsis-1",
            "labels": ".job-labels, .labels-box, [class*='label']", "title_extra": ".job-title-box",
        },
        True,
    ),
    "lagou": Rules(
        "div.job-box, li.con_list_item, a.position_link, div.list_item_top, div.passed_bar, .job-list li, div.job-card",
        "a.position_link, a.s-top-name, h3 a, a[href*='/jobs/'], a[href*='lagou.com/jobs']",
        (".position-name", "h3.position-name", ".s-top-name", "h3", ".job-name"),
        {
            "salary": ".money, .salary, [class*='money'], span.salary", "city": ".add, [class*='add'], span.add, .job-address",
            "tags": ".industry, .position-label, [class*='con_list_item']", "title_extra": ".position-name, h3, [class*='top']",
        },
        True,
    ),
    "bytedance": Rules(
        ".positionItem, a[href*='/detail'], a[href*='position/'], .job-list-item, div[class*='job-card'], li[class*='job-item']", "a",
        attributes={
            "city": "[class*='location'], [class*='city'], .job-location", "tags": "[class*='tag'], [class*='label'], .job-tags",
            "title_extra": "[class*='title'], .job-name, .job-subtitle",
        },
        rich=True,
    ),
    "generic": Rules("a.job-card, .job-listing a, .position a", "a"),
}
#: Titles within a link, if the card has none (fixed values).
LINK_TITLES = (".positionItem-title-text", "[class*='title-']")
TITLE_CHARS, CARD_CHARS = 500, 1000


class _Card:
    """A card, or a card's link: the first element that each selector matches within it, and its own text."""

    def __init__(self, element: Element):
        self.element, self.text, self.first, self.link = element, [], {}, None


class _Cards(Reader):
    def __init__(self, rules: Rules, matcher: Matcher):
        super().__init__(matcher)
        self.rules, self.cards, self.open, self.heard = rules, [], [], []

    def opens(self, element, names):
        if not names:
            return
        parts = names - {"card"}
        for card in self.open:
            if card.link is None and "link" in parts:
                card.link = _Card(element)
                self._listen(element, card.link.text)
            for name in parts:
                if name not in card.first:
                    card.first[name] = []
                    self._listen(element, card.first[name])
            if card.link is not None and card.link.element is not element and card.link.element in self.stack:
                for name in parts & {"link title 0", "link title 1"}:
                    if name not in card.link.first:
                        card.link.first[name] = []
                        self._listen(element, card.link.first[name])
        if "card" in names:
            card = _Card(element)
            self.cards.append(card)
            self.open.append(card)
            self._listen(element, card.text)
            if element.tag == "a":
                card.link = card  # its own link; what is within it are its titles
                card.first = {}
            element.notes.append(card)

    def _listen(self, element: Element, to: list[str]) -> None:
        element.notes.append(to)
        self.heard.append(to)

    def closes(self, element):
        for note in element.notes:
            within = self.open if isinstance(note, _Card) else self.heard
            within[:] = [x for x in within if x is not note]

    def says(self, text):
        if text := text.strip():
            for to in self.heard:
                to.append(text)

    def title(self, card: _Card) -> str:
        for k in range(len(self.rules.titles)):
            if found := "".join(card.first.get(f"title {k}", [])):
                return found
        for k in range(len(LINK_TITLES)):
            if (found := card.link.first.get(f"link title {k}")) is not None:
                return "".join(found)
        return "".join(card.link.text)


def _matcher(rules: Rules) -> Matcher:
    groups = {"card": rules.cards, "link": rules.link} | {f"title {k}": s for k, s in enumerate(rules.titles)}
    return Matcher(groups | {f"link title {k}": s for k, s in enumerate(LINK_TITLES)} | {f"= {k}": s for k, s in rules.attributes.items()})


_MATCHERS: dict[str, tuple[Rules, Matcher]] = {}


def _absolute(href: str, base: str) -> str | None:
    try:
        url = href if href.startswith("http") else urljoin(base, href)
        parts = urlsplit(url)
        parts.port  # noqa: B018  raises if it is none
    except ValueError:
        return None
    return url if parts.scheme in ("http", "https") and parts.hostname and not any(c.isspace() for c in url.strip()) else None


def listed(html: str | None, platform: str, base: str = "https://example.com") -> list[tuple]:
    """(place, title, url, blob, low, high, months, attributes) of each card that has a link and a title; the first card of a link wins."""
    if not html or not html.strip():
        return []
    name = platform if platform in PLATFORMS else "generic"
    if name not in _MATCHERS:
        _MATCHERS[name] = (PLATFORMS[name], _matcher(PLATFORMS[name]))
    rules, matcher = _MATCHERS[name]
    page, seen, out = _Cards(rules, matcher), set(), []
    page.read(html)
    for card in page.cards:
        href = card.link.element.attrs.get("href", "") if card.link else ""
        if not href.strip() or href.strip() in seen:
            continue
        seen.add(href.strip())
        title = page.title(card)[:TITLE_CHARS]
        url = _absolute(href, base) if title else None
        if url is None:
            continue
        attributes = {k: " ".join(card.first.get(f"= {k}", [])) for k in rules.attributes}
        parts = [title, *(v for v in attributes.values() if v), " ".join(card.text)[:CARD_CHARS]] if rules.rich else [title]
        blob = " | ".join(parts)
        low, high, months = jobs.card_salary(blob)
        attributes |= {k: str(v) for k, v in (("salary_min_k", low), ("salary_max_k", high), ("salary_months", months)) if v is not None}
        out.append((len(out), title, url, blob, low, high, months, attributes))
    return out


class JobCards:
    """Rows of one page; a null or blank page, and one without cards, has none."""

    def eval(self, html: str, platform: str, base: str):
        yield from listed(html, platform or "generic", base or "https://example.com")


def job_cards():
    """The table function (html, platform, base url): to be called in a lateral join or registered for SQL."""
    return udtf(JobCards, returnType="place int, title string, url string, blob string, low int, high int, months int, attributes map<string,string>")


def candidates(pages: DataFrame, html: str, platform: str, base: str = "https://example.com") -> DataFrame:
    """The pages' other columns with place, title, url, city, kind, low, high, months and attributes of each card."""
    rows = pages.lateralJoin(job_cards()(F.col(html).outer(), F.col(platform).outer(), F.lit(base)))
    city = F.coalesce(jobs.city(F.col("blob")), F.when(F.length(F.col("attributes")["city"]) > 0, F.col("attributes")["city"]))
    return rows.select(*[c for c in pages.columns if c != html], "place", "title", "url", city.alias("city"), jobs.employment_type(F.col("blob")).alias("kind"), "low", "high", "months", "attributes")


def observed(html, platform):
    """How many cards with a link and a title a page has."""

    def run(pages: pd.Series, platforms: pd.Series) -> pd.Series:
        return pd.Series([len(listed(h, p)) for h, p in zip(pages, platforms, strict=True)], dtype="int32")

    return F.pandas_udf(run, "int")(html, platform)


def list_status(pages: DataFrame, html: str, platform: str) -> DataFrame:
    """The pages' other columns with the number of rows, the page's digest, and how it came out: `failed` if it is blank, `partial`
    without a row, else `succeeded`."""
    blank = F.coalesce(F.col(html), F.lit("")).rlike(r"(?U)\A\s*\z")
    out = pages.withColumn("observed", observed(F.col(html), F.col(platform)))
    status = F.when(blank, "failed").when(F.col("observed") == 0, "partial").otherwise("succeeded")
    return out.select(*[c for c in pages.columns if c != html], "observed", status.alias("status"), F.when(~blank, F.sha2(html, 256)).alias("fingerprint"))
