"""Posts of Atom documents, one feed a row, by the standard library's XML reader.

A feed that is no XML or no Atom, or that declares a document type, fails as a whole; one entry
without a usable id is dropped. Feeds give no votes and no comment counts, so both are null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone
from html.parser import HTMLParser
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

NS = "{http://www.w3.org/2005/Atom}"
BODY_CHARS = 5000
POST = "id string, title string, author string, subreddit string, url string, body string, created string, score long, num_comments long"
_NAMES = [c.split()[0] for c in POST.split(", ")]
_FULLNAME = re.compile("t3_[a-z0-9]+", re.I)


class FeedError(ValueError):
    """The document is not a feed that can be read."""


class _Body(HTMLParser):
    """Text inside the first div of class md, each piece between tags stripped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.pieces = 0, False, [""]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.pieces.append("")
        if self.depth:
            self.depth += tag == "div"
        elif tag == "div" and not self.done and "md" in (dict(attrs).get("class") or "").split():
            self.depth = 1

    def handle_endtag(self, tag: str) -> None:
        self.pieces.append("")
        if self.depth and tag == "div":
            self.depth -= 1
            self.done = not self.depth

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.pieces[-1] += data


def body_text(markup: str | None) -> str:
    reader = _Body()
    reader.feed(markup or "")
    reader.close()
    return "".join(p.strip() for p in reader.pieces)[:BODY_CHARS]


def naive_utc(stamp: str | None) -> str | None:
    """An ISO-8601 stamp as naive UTC text; what cannot be read is null."""
    try:
        t = datetime.fromisoformat((stamp or "").strip())
    except ValueError:
        return None
    return str((t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t).replace(microsecond=0))


def read_entry(entry: ElementTree.Element) -> dict | None:
    """The post of one entry, or None without a fullname in its id."""
    link = entry.find(NS + "link")
    href = link.get("href", "") if link is not None else ""
    name = _FULLNAME.search(entry.findtext(NS + "id") or "")
    if not name:
        return None
    category = entry.find(NS + "category")
    parts = urlsplit(href)
    by_path = re.search("/r/([^/]+)", href)
    author = re.sub("^/?u/", "", (entry.findtext(f"{NS}author/{NS}name") or "").strip())
    return {
        "id": name[0],
        "title": (entry.findtext(NS + "title") or "").strip(),
        "author": author or "[deleted]",
        "subreddit": (category.get("term") if category is not None else "") or (by_path[1] if by_path else ""),
        "url": parts._replace(scheme="https", netloc="www.reddit.com").geturl() if parts.netloc else href,
        "body": body_text(entry.findtext(NS + "content")),
        "created": naive_utc(entry.findtext(NS + "published")) or naive_utc(entry.findtext(NS + "updated")),
    }


def read_feed(xml: str) -> list[dict]:
    """Posts of one feed; an empty feed has none."""
    if "<!DOCTYPE" in xml:
        raise FeedError("document types are not read")
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        raise FeedError(f"no XML: {e}") from e
    if root.tag != NS + "feed":
        raise FeedError(f"no Atom feed: {root.tag}")
    return [p for p in map(read_entry, root.iter(NS + "entry")) if p]


def posts(feeds: DataFrame, strict: bool = True) -> DataFrame:
    """Posts of every feed (a column xml); with strict off, an unreadable feed gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for xml in b["xml"].dropna():
                try:
                    rows += read_feed(xml)
                except FeedError:
                    if strict:
                        raise
            out = pd.DataFrame(rows, columns=_NAMES)
            yield out.astype({"score": "Int64", "num_comments": "Int64"})

    return feeds.select("xml").mapInPandas(run, POST)
