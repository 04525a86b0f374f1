"""HTML to text and links, with the standard library's parser, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

_SILENT = {"script", "style", "noscript", "template"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "main", "title", "body", "blockquote"}


class Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.links, self.silent, self.in_title, self.link = [], [], [], 0, False, None

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCK:
            self.parts.append(" ")
        self.in_title = self.in_title or tag == "title"
        if tag == "a" and (href := dict(attrs).get("href")):
            self.link = [href, []]
            self.links.append(self.link)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in _BLOCK:
            self.parts.append(" ")
        if tag == "title":
            self.in_title = False
        if tag == "a":
            self.link = None

    def handle_data(self, data):
        if self.silent:
            return
        if self.in_title:
            self.title.append(data)
            return
        self.parts.append(data)
        if self.link:
            self.link[1].append(data)


def read(html: str) -> tuple[str, str, list[tuple[str, str]]]:
    """(text, title, [(href, label)]), white space collapsed."""
    page = Page()
    page.feed(html)
    page.close()
    squeeze = lambda parts: " ".join("".join(parts).split())
    return squeeze(page.parts), squeeze(page.title), [(href, squeeze(label)) for href, label in page.links]


def _parsed(pages: pd.Series) -> pd.DataFrame:
    rows = [read(h) if h is not None else (None, None, None) for h in pages]
    return pd.DataFrame({"text": [r[0] for r in rows], "title": [r[1] for r in rows], "links": [None if r[2] is None else [{"href": h, "label": x} for h, x in r[2]] for r in rows]})


def parsed(html):
    """Struct (text, title, links)."""
    return F.pandas_udf(_parsed, "struct<text:string,title:string,links:array<struct<href:string,label:string>>>")(html)
