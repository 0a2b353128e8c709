"""Secret scans: an Aho-Corasick prefilter, anchored expressions near its hits, embedded checksums.

One automaton finds the keywords of all kinds in a text whose A-Z are lower-cased; only where a
keyword stands, the kind's expression is matched, anchored there, on the text itself. Bare hex
digits have no keyword: a run of 24 holds three neighbours of every eighth character, so the
expression is tried only where three such neighbours are hex digits. Kinds beyond the base ones
carry a proof in themselves (a checksum, or a header that must decode) and count only if it holds.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, table


def base62_crc(value: str) -> bool:
    """Whether the last six of the 36 characters after the prefix are the CRC-32 of the others."""
    body = value[value.index("_") + 1 :]
    left, shown = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        left, digit = divmod(left, 62)
        shown = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[digit] + shown
    return shown == body[-6:]


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58_check(value: str) -> bool:
    """Whether the last four bytes are the start of the double SHA-256 of the others."""
    number = 0
    for c in value:
        number = number * 58 + BASE58.index(c)
    raw = number.to_bytes(82, "big") if number < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def bech32(value: str) -> bool:
    """Whether the last six characters are the BCH checksum of prefix and data."""
    prefix, _, data = value.lower().rpartition("1")
    check = 1
    for v in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *map(BECH32.index, data)]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, by in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= by if top >> i & 1 else 0
    return check == 1


def token_header(value: str) -> bool:
    """Whether the part before the first point is a JSON object that names an algorithm."""
    head = value.split(".", 1)[0]
    try:
        got = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and isinstance(got.get("alg"), str)


def private_key(value: str) -> bool:
    """Whether the body is Base64 of a sequence whose length is the one it states, or of an OpenSSH key."""
    try:
        raw = base64.b64decode("".join(value.split("-----")[2].split()), validate=True)
    except binascii.Error:
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    more = raw[1] & 127 if raw[1] & 128 else 0
    return len(raw) == 2 + more + (int.from_bytes(raw[2 : 2 + more], "big") if more else raw[1])


@dataclass(frozen=True)
class Kind:
    """keywords in lower case, each the start of a match of form; valid: what a match must be."""

    name: str
    keywords: tuple[str, ...]
    form: re.Pattern
    valid: Callable[[re.Match], bool]


def _kind(name: str, keywords: str, form: str, valid: Callable[[re.Match], bool]) -> Kind:
    return Kind(name, tuple(keywords.split()), re.compile(form, re.ASCII), valid)


#: The base kinds that have keywords; `hex` has none.
ASSIGN = _kind(
    "assign", "password passwd secret token apikey api_key",
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    lambda m: m.end(1) - m.start(1) >= 6,
)
ACCESS = _kind("access", "akia", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20)
HEX, RUN, STEP = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}"), re.compile(r"[0-9a-f]{3,}"), 8
#: Kinds with a proof in themselves. An expression starts where nothing can be left of a match,
#: or has a fixed length, so that no character is looked at by many hits.
PROVEN = (
    _kind("github", "ghp_ gho_ ghu_ ghs_ ghr_", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", lambda m: base62_crc(m[0])),
    _kind("npm", "npm_", r"(?<![A-Za-z0-9_])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", lambda m: base62_crc(m[0])),
    _kind("jwt", "eyj", r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", lambda m: token_header(m[0])),
    _kind("pem", "-----begin", r"-----BEGIN ((?:[A-Z]+ ){0,2}PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----", lambda m: private_key(m[0])),
    _kind("wallet", "xprv tprv yprv zprv", rf"(?<![{BASE58}])[xtyz]prv[{BASE58}]{{107}}(?![{BASE58}])", lambda m: base58_check(m[0])),
    _kind("age", "age-secret-key-1", rf"AGE-SECRET-KEY-1[{BECH32.upper()}]{{58}}(?![A-Z0-9])", lambda m: bech32(m[0])),
    _kind("nostr", "nsec1", rf"(?<![A-Za-z0-9])nsec1[{BECH32}]{{58}}(?![a-z0-9])", lambda m: bech32(m[0])),
)
#: All kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", *(k.name for k in PROVEN))
BASE = KINDS[:3]

_machine: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    if not _machine:
        machine = ahocorasick.Automaton()
        for kind in (ASSIGN, ACCESS, *PROVEN):
            for word in kind.keywords:
                machine.add_word(word, (kind, len(word)))
        machine.make_automaton()
        _machine.append(machine)
    return _machine[0]


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of all runs of at least 24 hex digits in lower case."""
    for m in RUN.finditer(text[::STEP]):
        # the eighth characters before and after m are no hex digits: a run that m is in ends between
        for run in HEX.finditer(text, max(0, STEP * (m.start() - 1) + 1), STEP * m.end()):
            yield run.span()


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of text by start, then kind; code points, end exclusive."""
    lower = text.lower() if text.isascii() else text.encode().lower().decode()  # A-Z only
    hits: dict[str, tuple[Kind, list[int]]] = {}
    for end, (kind, n) in automaton().iter(lower):
        hits.setdefault(kind.name, (kind, []))[1].append(end + 1 - n)
    found = [("hex", *span) for span in hex_runs(text)]
    for name, (kind, starts) in hits.items():
        free = 0
        for at in starts:
            m = kind.form.match(text, at) if at >= free else None
            if m:
                free = m.end()
                if kind.valid(m):
                    found.append((name, at, free))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id and found, an array of (kind, start, end), for every row of docs (doc_id, text).

    Null text is empty and holds nothing: an empty array. Of a kind, matches are leftmost and do
    not overlap, and those that fail its rule still cover their characters; different kinds may
    overlap. Rows are independent: repeats, ties and null ids stay as they are.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return by_rows(rows, lambda b: {"doc_id": b["doc_id"], "found": [scan(t) for t in b["text"]]}, f"doc_id {kind}, found array<struct<kind:string,start:long,end:long>>")


def listed(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
