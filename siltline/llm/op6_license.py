"""Licence scans: one Aho-Corasick pass for phrases, one for tags, expressions by shunting-yard.

Notice phrases are matched on the text's words, so punctuation and line breaks do not matter;
identifier tags are matched on the text itself and followed by an expression of identifiers
joined by AND, OR and WITH.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM, by_rows, table, utf8

#: Phrases that every scan looks for, and the labels they give.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases of this scanner: names of licences, and sentences of their texts.
NOTICES = {
    "academic free license": "afl",
    "affero general public license": "agpl",
    "apache software license": "apache",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "common development and distribution license": "cddl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4 0 international": "cc-by",
    "creative commons zero": "cc0",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "isc license": "isc",
    "microsoft public license": "ms-pl",
    "mozilla public license": "mpl",
    "open database license": "odbl",
    "open software license": "osl",
    "sil open font license": "ofl",
    "universal permissive license": "upl",
    "zlib license": "zlib",
    "all rights reserved": "proprietary",
    "confidential and proprietary": "proprietary",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "licensed under the apache license": "apache",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "this program is free software you can redistribute it": "gpl",
    "under the bsd license": "bsd",
    "unauthorized copying of this file": "proprietary",
}
#: Tags whose expression is taken as it is, and tags of package files, whose expression counts
#: only where all its identifiers are known.
TAGS = ("spdx-license-identifier:", "license-expression:")
PACKAGE_TAGS = ('"license":', '"licence":', "license =", "license=", "license:", "licence:", "<license>")
#: Identifiers and exceptions that package tags may name (fixed values of the public list).
KNOWN = frozenset(
    """0bsd afl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 bsd-1-clause bsd-2-clause
    bsd-3-clause bsd-4-clause bsl-1.0 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0
    cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3-only
    gfdl-1.3-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later isc lgpl-2.1
    lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl
    mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 ruby unlicense upl-1.0
    vim w3c wtfpl x11 zlib zpl-2.1 autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0
    font-exception-2.0 gcc-exception-3.1 libtool-exception linux-syscall-note llvm-exception openssl-exception
    openvpn-openssl-exception wxwindows-exception-3.1""".split()
)
PERMISSIVE = frozenset(
    """mit mit-0 0bsd apache apache-2 apache-1.1 apache-2.0 bsd bsd-1-clause bsd-2-clause bsd-3-clause bsl bsl-1.0 isc
    public-domain cc0 cc0-1.0 ncsa postgresql psf-2.0 python-2.0 unlicense upl upl-1.0 wtfpl x11 zlib""".split()
)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def longest(tokens: Iterable[str]) -> tuple[list[str] | None, int]:
    """(postfix order, number of tokens) of the longest prefix that is an expression, by one run
    of the shunting-yard method; None where no prefix is. `with` joins two identifiers only."""
    out: list[str] = []
    held: list[str] = []
    best, n, depth, before = None, 0, 0, ""  # before: what the last token was
    for t in tokens:
        due = before in ("", "or", "and", "with", "(")
        if t == "(":
            if not due or before == "with":
                break
            held.append(t)
            depth += 1
            before = t
        elif t == ")":
            if due or not depth:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
            before = t
        elif t in _RANK:
            if due or t == "with" and before != "id":
                break
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[t]:
                out.append(held.pop())
            held.append(t)
            before = t
        else:
            if not due:
                break
            out.append(t)
            before = "exception" if before == "with" else "id"
        n += 1
        if not depth and before not in _RANK:
            best = (len(out), held[::-1], n)  # at most three operators are held outside brackets
    return (out[: best[0]] + best[1], best[2]) if best else (None, 0)


def postfix(tokens: list[str]) -> list[str] | None:
    """The tokens in postfix order; None if they are no expression."""
    rpn, n = longest(tokens)
    return rpn if n == len(tokens) else None


def evaluate(rpn: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[set[str], bool]:
    """(labels, whether the licence can be met by allowed ones alone) of a postfix expression."""
    stack: list[tuple[set[str], bool]] = []
    for t in rpn:
        if t not in _RANK:
            stack.append(({t}, t in allowed))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        if t == "with":
            stack.append(({f"{min(a)}-with-{min(b)}"}, x))  # one identifier, one exception
            continue
        large, few = (a, b) if len(a) >= len(b) else (b, a)
        large |= few
        stack.append((large, x and y if t == "and" else x or y))
    return stack.pop()


def tokens_at(text: str, at: int) -> Iterator[str]:
    """Brackets, operators and identifiers from text[at:] on, as far as there is nothing else on the line."""
    while m := _TOKEN.match(text, at):
        yield m[1]
        at = m.end()


def expression_at(text: str, at: int) -> list[str] | None:
    """Postfix form of the longest expression that starts at text[at:] on one line; quotes before it are skipped."""
    while at < len(text) and text[at] in " \t\"'":
        at += 1
    return longest(tokens_at(text, at))[0]


def _automaton(words: dict[str, object]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, value in words.items():
        a.add_word(w, value)
    a.make_automaton()
    return a


_machines: list[ahocorasick.Automaton] = []


def scan(text: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, permissive)."""
    if not _machines:
        phrases = {f" {p} ": (p.count(" ") + 1, label, True) for p, label in BASE.items()}
        phrases |= {f" {p} ": (p.count(" ") + 1, label, False) for p, label in NOTICES.items()}
        _machines.extend([_automaton(phrases), _automaton({t: True for t in TAGS} | {t: False for t in PACKAGE_TAGS})])
    notices, tags = _machines
    words = text.translate(ALNUM).split()
    joined = b" " + b" ".join(words) + b" "
    flat, base, labels, starts, found = joined.decode("utf-8", "replace"), set(), set(), [], 0
    counted, word = 0, 0
    for end, (n, label, is_base) in notices.iter(flat):
        # the hit ends in the blank after its last word: count blanks up to there
        word += flat.count(" ", counted, end + 1)
        counted = end + 1
        labels.add(label)
        found += 1
        if is_base:
            base.add(label)
            starts.append(word - 1 - n)
    lower = text.lower().decode("utf-8", "replace")  # A-Z only
    met = None
    if "licen" in lower:
        for end, sure in tags.iter(lower):
            rpn = expression_at(lower, end + 1)
            if rpn and (sure or all(t in _RANK or t in KNOWN for t in rpn)):
                got, ok = evaluate(rpn)
                labels |= got
                found += 2
                met = ok if met is None else met and ok
    if met is None and labels:
        met = labels <= PERMISSIVE
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - 0.5**found, met,
    )


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id and what scan() finds, for every row of docs (doc_id, text).

    Null text is empty: no words, no places, null first_word and last_word, empty labels, score
    0, permissive null. score grows with the evidence: half the doubt is left by each phrase, a
    quarter by each tag. Rows are independent: repeats, ties and null ids stay as they are.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(b: dict[str, list]) -> dict[str, list]:
        cols = list(zip(*map(scan, b["text"]), strict=True)) or [[]] * len(names)
        return {"doc_id": b["doc_id"]} | dict(zip(names, map(list, cols), strict=True))

    return by_rows(docs.select("doc_id", utf8().alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
