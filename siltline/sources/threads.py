"""Posts' own pages: votes, the community's box and comments.

Each page is read inside an Arrow batch by the standard library's tolerant parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID = frozenset({"br", "hr", "img", "input", "link", "meta", "wbr"})
_NUMBER = re.compile(r"-?\d+")


class _Thread(HTMLParser):
    """Keeps the open elements; text goes to every open element that somebody wants."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset]] = []
        self.comments: list[dict] = []
        self.inside: list[tuple[int, dict]] = []  # depth and record of the comments that are open
        self.want: list[tuple[int, list]] = []  # depth and pieces of the texts that are open
        self.thing: dict | None = None
        self.about: list | None = None
        self.number: list | None = None

    def _under(self, *classes: str) -> bool:
        """Whether open elements, outermost first, have these classes."""
        at = 0
        for _, have in self.open:
            at += at < len(classes) and classes[at] in have
        return at == len(classes)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = dict(attrs)
        names = frozenset((have.get("class") or "").split())
        if tag == "div" and {"thing", "link"} <= names and self.thing is None:
            self.thing = have
        if tag in VOID:
            return
        depth = len(self.open)
        if tag == "div" and "comment" in names:
            record = {"author": None, "body": None, "votes": None}
            self.comments.append(record)
            self.inside.append((depth, record))
        kind = "author" if tag == "a" and "author" in names else "votes" if tag == "span" and "score" in names else None
        if "md" in names and self.inside and any("usertext" in h for _, h in self.open[self.inside[0][0] + 1 :]):
            kind = "body"
        pieces: list[str] = []
        for _, record in self.inside:
            if kind and record[kind] is None:
                record[kind] = pieces
        if "md" in names and self.about is None and self._under("titlebox", "usertext-body"):
            self.about = pieces
        if "number" in names and self.number is None and self._under("subscribers"):
            self.number = pieces
        self.open.append((tag, names))
        self.want.append((depth, pieces))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        del self.open[at:]
        self.inside = [x for x in self.inside if x[0] < at]
        self.want = [x for x in self.want if x[0] < at]

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        for _, pieces in self.want:
            if piece:
                pieces.append(piece)


def _whole(raw: str | None) -> int | None:
    return int(raw) if raw and raw.lstrip("-").isdecimal() and raw.count("-") <= 1 else None


def read_thread(html: str | None) -> tuple:
    """(score, num_comments, about, subscribers, comments); unknown figures are None, comments
    without a body are left out, a comment without votes has 0 and without author is deleted."""
    p = _Thread()
    p.feed(html or "")
    p.close()
    thing = p.thing or {}
    number = "".join(p.number or []).replace(",", "")
    rows = []
    for c in p.comments:
        body, votes = "".join(c["body"] or []), _NUMBER.search("".join(c["votes"] or []))
        author = "[deleted]" if c["author"] is None else "".join(c["author"])
        if body:
            rows.append({"author": author, "body": body, "score": int(votes[0]) if votes else 0})
    about = "".join(p.about or [])[:500]
    return _whole(thing.get("data-score")), _whole(thing.get("data-comments-count")), about, int(number) if number.isdecimal() else 0, rows


def read(pages: DataFrame) -> DataFrame:
    """conv_id, turn and what read_thread() finds of every page (conv_id, turn, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = list(zip(*map(read_thread, b["html"]), strict=True)) or [[]] * 5
            cols = dict(zip(("score", "num_comments", "about", "subscribers", "comments"), got, strict=True))
            cols["score"], cols["num_comments"] = (pd.array(cols[n], "Int64") for n in ("score", "num_comments"))
            yield pd.DataFrame({"conv_id": b["conv_id"].array, "turn": b["turn"].array, **cols})

    ddl = "conv_id long, turn long, score long, num_comments long, about string, subscribers long, comments array<struct<author: string, body: string, score: long>>"
    return pages.mapInPandas(run, ddl)
