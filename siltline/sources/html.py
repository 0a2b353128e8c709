"""Text, links and labels of web pages, by the standard library's tolerant parser.

Each function works on one page's markup inside an Arrow batch; pages never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

SKIPPED = frozenset({"script", "style", "nav", "footer", "header"})
PRIORITY_PATHS = ("/pricing", "/product", "/features", "/solutions", "/use-cases", "/about", "/customers", "/how-it-works")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.labels, self.title = [], [], [], ""
        self.skip: list[str] = []
        self.anchor: list[str] | None = None
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip.append(tag)
        self.in_title |= tag == "title"
        if tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.anchor = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skip:
            del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
        self.in_title &= tag != "title"
        if tag == "a" and self.anchor is not None:
            label = " ".join("".join(self.anchor).split())
            if ("nav" in self.skip or "footer" in self.skip) and label and len(label) <= 40 and label not in self.labels:
                self.labels.append(label)
            self.anchor = None

    def handle_data(self, data: str) -> None:
        if self.anchor is not None:
            self.anchor.append(data)
        if self.in_title:
            self.title += data
        elif not self.skip and data.strip():
            self.text.append(data)


def read_page(html: str | None) -> tuple[str, str, list[str], list[str]]:
    """(title, text without chrome, hrefs, navigation labels); broken markup gives what it can."""
    p = _Page()
    p.feed(html or "")
    p.close()
    return " ".join(p.title.split()), " ".join(" ".join(p.text).split()), p.links, p.labels


def priority_rank(path: str) -> int | None:
    """Place of the path's prefix in PRIORITY_PATHS; None for others."""
    path = path.rstrip("/").lower()
    return next((i for i, p in enumerate(PRIORITY_PATHS) if path == p or path.startswith((p + "/", p + "-"))), None)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, title, text, links, labels of every page (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read_page(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], **{n: [g[i] for g in got] for i, n in enumerate(("title", "text", "links", "labels"))}})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, text string, links array<string>, labels array<string>")


def own_links(pages: DataFrame) -> DataFrame:
    """page_id, base (the page's url) and links: the page's absolute http links to its own host,
    without query and fragment, of every page (page_id, url, html)."""

    def of(base: str, found: list[str]) -> list[str]:
        out = []
        for href in map(str.strip, found):
            if href and not href.startswith(("#", "mailto:", "tel:", "javascript:")):
                u = urlsplit(urljoin(base, href))
                if u.scheme in ("http", "https") and u.netloc.lower() == urlsplit(base).netloc.lower():
                    out.append(f"{u.scheme}://{u.netloc.lower()}{u.path}")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            links = [of(u or "", read_page(h)[2]) for u, h in zip(b["url"], b["html"])]
            yield pd.DataFrame({"page_id": b["page_id"], "base": b["url"], "links": links})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, base string, links array<string>")
