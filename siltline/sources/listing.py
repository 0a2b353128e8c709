"""Posts of HTML listing and search pages, one page a row, by the tolerant standard parser.

Unknown is null: a listing row without a comments link has no count, one whose link holds no
digit has zero. Search rows differ: without a count they have zero. Rows without an id are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

from .atom import BODY_CHARS, naive_utc

BASE = "https://old.reddit.com"
SHOWN = "https://www.reddit.com"
POST = "page long, id string, title string, author string, subreddit string, url string, body string, created string, score long, num_comments long, next_url string"
_NAMES = [c.split()[0] for c in POST.split(", ")]
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Layout:
    """Class names of a page kind: its rows, the anchors in a row, and what holds the body."""

    row: frozenset[str]
    title: str
    comments: str
    body: str
    author: str = ""
    subreddit: str = ""

    def field(self, tag: str, classes: set[str], held: list[set[str]]) -> str | None:
        if tag == "a":
            named = ((self.title, "title"), (self.comments, "comments"), (self.author, "author"), (self.subreddit, "subreddit"))
            return next((f for c, f in named if c in classes), None)
        return "body" if "md" in classes and any(self.body in c for c in held) else None


# Class names of the two page kinds.
LISTING = Layout(frozenset({"thing", "link"}), "title", "comments", "expando")
SEARCH = Layout(frozenset({"search-result-link"}), "search-title", "search-comments", "search-result-body", "author", "search-subreddit-link")


class _Rows(HTMLParser):
    def __init__(self, layout: Layout) -> None:
        super().__init__(convert_charrefs=True)
        self.layout, self.rows = layout, []
        self.open: list[tuple[str, set[str]]] = []
        self.row_depth: int | None = None
        self.fields: list[tuple[int, str]] = []
        self.groups: list[dict] = []
        self.group: tuple[int, dict] | None = None
        self.nexts: list[tuple[str, bool]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = {k: v or "" for k, v in attrs}
        classes, held = set(at.get("class", "").split()), [c for _, c in self.open]
        depth = len(self.open)
        if tag == "div" and "search-result-group" in classes:
            self.group = (depth, {"rows": 0, "next": None})
            self.groups.append(self.group[1])
        if tag == "div" and self.layout.row <= classes:
            self.rows.append({"attrs": at})
            self.row_depth, self.fields = depth, []
            if self.group:
                self.group[1]["rows"] += 1
        elif self.row_depth is not None:
            name = self.layout.field(tag, classes, held[self.row_depth :])
            if name and name not in self.rows[-1]:
                self.rows[-1] |= {name: "", name + "_href": at.get("href", "")}
                self.fields.append((depth, name))
            if tag == "time":
                self.rows[-1].setdefault("time", at.get("datetime", ""))
        if tag == "a" and "next" in at.get("rel", "").split() and at.get("href"):
            self.nexts.append((at["href"], any("nextprev" in c for c in held)))
            if self.group and self.group[1]["next"] is None and any("nav-buttons" in c for c in held):
                self.group[1]["next"] = at["href"]
        if tag not in _VOID:
            self.open.append((tag, classes))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in reversed(range(len(self.open))) if self.open[i][0] == tag), None)
        if at is None:
            return
        del self.open[at:]
        self.fields = [f for f in self.fields if f[0] < at]
        if self.row_depth is not None and self.row_depth >= at:
            self.row_depth, self.fields = None, []
        if self.group and self.group[0] >= at:
            self.group = None

    def handle_data(self, data: str) -> None:
        for _, name in self.fields:
            self.rows[-1][name] += data.strip()

    def next_url(self) -> str | None:
        """Listing: the pager's link. Search: that of a group with posts, else one after a post."""
        if self.layout == LISTING:
            href = next((h for h, pager in self.nexts if pager), None)
        else:
            href = next((g["next"] for g in self.groups if g["rows"] and g["next"]), None)
            href = href or next((h for h, _ in self.nexts if "after=t3_" in h), None)
        return urljoin(BASE, href) if href else None


def _created(row: dict) -> str | None:
    try:
        stamp = datetime(1970, 1, 1) + timedelta(milliseconds=int(row["attrs"].get("data-timestamp", "")))
    except (ValueError, OverflowError):
        return naive_utc(row.get("time"))
    return str(stamp.replace(microsecond=0))


def read_rows(html: str | None, layout: Layout) -> list[dict]:
    """Posts of one page with the address of the page after it."""
    reader = _Rows(layout)
    reader.feed(html or "")
    reader.close()
    out, after = [], reader.next_url()
    for row in reader.rows:
        at, url = row["attrs"], row.get("title_href", "")
        if not at.get("data-fullname"):
            continue
        votes, digits = at.get("data-score", ""), re.search("[0-9]+", row.get("comments", ""))
        unknown = None if layout == LISTING and "comments" not in row else 0
        out.append(
            {
                "id": at["data-fullname"],
                "title": row.get("title", ""),
                "author": at.get("data-author", "[deleted]") if layout == LISTING else row.get("author", "[deleted]"),
                "subreddit": at.get("data-subreddit", "") if layout == LISTING else row.get("subreddit", "").replace("r/", ""),
                "url": SHOWN + url if url.startswith("/") else url,
                "body": row.get("body", "")[:BODY_CHARS],
                "created": _created(row),
                "score": int(votes) if re.fullmatch("-*[0-9]+", votes) and votes.count("-") < 2 else None,
                "num_comments": int(digits[0]) if digits else unknown,
                "next_url": after,
            }
        )
    return out


def posts(pages: DataFrame, layout: Layout) -> DataFrame:
    """Posts of every page (page, html); a page that holds none gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"page": p} | r for p, h in zip(b["page"], b["html"]) for r in read_rows(h, layout)]
            yield pd.DataFrame(rows, columns=_NAMES).astype({"page": "Int64", "score": "Int64", "num_comments": "Int64"})

    return pages.select("page", "html").mapInPandas(run, POST)
