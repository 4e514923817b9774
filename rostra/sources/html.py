"""SRC-4/5: notice lists and links out of saved HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANCHOR = r'(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'


def anchors(html: Column) -> Column:
    """array<struct<href, text>> of regular markup (quoted attributes, anchors not nested), in page order, in the JVM."""
    hrefs, texts = (F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(hrefs.alias("href"), F.transform(texts, lambda t: F.trim(F.regexp_replace(t, "<[^>]*>", ""))).alias("text"))


# The classes that mark the notice list, its items and their titles.
_LIST, _ITEM, _TITLE = ("div", "col_news_con"), ("li", "news"), ("span", "news_title")


class _Links(HTMLParser):
    """Anchors, and of each whether it stands in an item of the notice list and in that item's title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, set[str]]] = []
        self.links: list[dict] = []
        self.open: dict | None = None
        self.items = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attributes = dict(attrs)
        self.stack.append((tag, set((attributes.get("class") or "").split())))
        if tag == _ITEM[0] and _ITEM[1] in self.stack[-1][1]:
            self.items += 1
        if tag == "a":
            has = lambda tag, mark: any(x == tag and mark in k for x, k in self.stack)
            listed = has(*_LIST) and has(*_ITEM)
            self.open = {
                "href": attributes.get("href"), "title": attributes.get("title"), "text": "", "listed": listed,
                "titled": listed and has(*_TITLE), "item": self.items if listed else None,
            }
            self.links.append(self.open)
        if tag in ("br", "img", "hr", "input", "meta", "link"):
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.open = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.open is not None:
            self.open["text"] += data


def parse_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, href, title, text, listed, titled, item) of every anchor of messy markup; null and empty pages have none.
    `listed`: the anchor stands in an item of the notice list, the `item`-th of the page; `titled`: in the title of that item. Batches of
    pages, one pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, page in zip(pdf[key], pdf[html], strict=True):
                parser = _Links()
                parser.feed(page or "")
                parser.close()
                rows += [(k, i, x["href"], x["title"], x["text"].strip(), x["listed"], x["titled"], x["item"]) for i, x in enumerate(parser.links)]
            out = pd.DataFrame(rows, columns=[key, "pos", "href", "title", "text", "listed", "titled", "item"])
            yield out.astype({"item": "Int32"})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, pos int, href string, title string, text string, listed boolean, titled boolean, item int")


def notices(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """SRC-4: (key, item, href, title, text) of the notice list of each page: of each item the first anchor in its title, or, where its title has
    none, the first one anywhere in the item. Items without any anchor are left out. An anchor is chosen by an aggregation with
    map-side combine."""
    found = parse_links(pages, key, html).filter("listed")
    first = F.min(F.struct((~F.col("titled")).alias("other"), "pos", "href", "title", "text"))
    return found.groupBy(key, "item").agg(first.alias("a")).select(key, "item", "a.href", "a.title", "a.text")
