"""Text and hash functions as Column expressions; all run on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a class of Java and, with other escapes, of RE2.
SPACE = r"[\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE_RE2 = SPACE.replace(r"\x85\xa0", r"\x{85}\x{a0}").replace(r"\u1680", r"\x{1680}").replace(r"\u3000", r"\x{3000}")
SPACE_RE2 = SPACE_RE2.replace(r"\u2000-\u200a\u2028\u2029\u202f\u205f", r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}")
#: A word of edit notes, told before lines are cut, and a line that starts an edit note.
EDIT_WORD = "(?i)edit|update"
EDIT_LINE = rf"(?i)^{SPACE}*(edit|update)([^\p{{L}}\p{{N}}_]|$)"

#: Characters that lower-casing leaves and full case folding changes, by Unicode's own rule.
FOLDED = {chr(c): chr(c).casefold() for c in range(0x110000) if chr(c).lower() == chr(c) != chr(c).casefold()}
ONE = {k: v for k, v in FOLDED.items() if len(v) == 1}
#: A text without such characters needs no more than Latin letters and ASCII blanks.
RARE = r"[\u0149-\x{10ffff}\x85\xa0]"
#: Runs of ASCII blanks that are not one blank already.
_BLANK = r"[\t-\r\x1c-\x1f][\t-\r \x1c-\x1f]*| [\t-\r \x1c-\x1f]+"
MANY = {k: v for k, v in FOLDED.items() if len(v) > 1 and k != "ß"}


#: Secrets and their replacements, applied in this order (fixed values).
SECRETS = (
    (r"\bsk-[A-Za-z0-9_\-]{16,}\b", "[REDACTED]"),
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._\-]{16,}", "$1 [REDACTED]"),
    (r"(?i)\b(api[_-]?key|apikey|token|secret|password|passwd|pwd)(\"?\s*[:=]\s*\"?)([^\s\",;}]{6,})", "$1$2[REDACTED]"),
    (r"\b([A-Za-z0-9_\-]{4,}):([^\s:@/]{4,})@([\w.\-]+:\d+)", "$1:[REDACTED]@$3"),
    (r"\b(bot)?(\d{8,12}):[A-Za-z0-9_\-]{35}\b", "$1$2:[REDACTED]"),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is made once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_trailing_edits(text: Column) -> Column:
    """The lines before the first edit note."""
    lines = F.split(text, "\n", -1)
    marks = F.transform(lines, lambda x: x.rlike(EDIT_LINE))
    at = F.array_position(marks, F.lit(True))
    return F.when(text.rlike(EDIT_WORD) & (at > 0), F.array_join(F.slice(lines, F.lit(1), (at - 1).cast("int")), "\n")).otherwise(text)


def _wide(text: Column) -> Column:
    return F.octet_length(text) > F.char_length(text)  # ASCII texts are told by their length


def _rare(text: Column) -> Column:
    return _wide(text) & text.rlike(RARE)


def _latin_fold(text: Column) -> Column:
    """Case folding of a text without rare characters."""
    low = F.lower(text)
    wide = F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))
    return F.when(_wide(text), wide).otherwise(low)


def _full_fold(text: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MANY.items() for x in pair))
    one = F.translate(_latin_fold(text), "".join(ONE), "".join(ONE.values()))
    return F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def casefold(text: Column) -> Column:
    """Full case folding. Texts with rare characters are folded character by character."""
    return F.when(_rare(text), _full_fold(text)).otherwise(_latin_fold(text))


def dedup_normal(text: Column) -> Column:
    """Folded text without edit notes, emphasis marks and repeated blanks; null is empty."""
    t = strip_trailing_edits(F.coalesce(text, F.lit("")))
    plain = F.btrim(F.regexp_replace(F.regexp_replace(_latin_fold(t), "[*_~`]", ""), _BLANK, " "))
    full = F.btrim(F.regexp_replace(F.regexp_replace(_full_fold(t), "[*_~`]", ""), f"{SPACE}+", " "))
    return F.when(_rare(t), full).otherwise(plain)


def cache_normal(text: Column) -> Column:
    """Folded text without what follows an edit mark, emphasis marks and repeated blanks."""
    t = F.regexp_replace(text, rf"(?is)\n*{SPACE}*(edit|update){SPACE}*[0-9]*{SPACE}*:.*$", "")
    return bound(F.btrim(F.regexp_replace(F.regexp_replace(t, "[*_~`]+", ""), f"{SPACE}+", " ")), casefold)


def content_hash(title: Column, body: Column) -> Column:
    return normal_hash(dedup_normal(title), dedup_normal(body))


def normal_hash(title: Column | str, body: Column | str) -> Column:
    """content_hash of what is normalised already."""
    return F.sha2(F.concat(title, F.lit("\n"), body), 256)


def keyword_normal(text: Column) -> Column:
    """Folded words with one blank between them; ASCII punctuation parts words."""
    return F.btrim(F.regexp_replace(casefold(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x5E\x60\x7B-\x7F]+", " "))


def shingles(text: Column, k: int = 5) -> Column:
    """The set of k-character substrings; shorter texts are one shingle, empty ones have none."""
    # the one-element array binds the text's characters, so they are split once
    every = F.transform(
        F.array(F.split(text, "")),
        lambda c: F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(c, i, F.lit(k)), ""))
        ),
    )
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.get(every, F.lit(0)))


def stable_hash(key: Column) -> Column:
    """The first eight bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def redact(text: Column) -> Column:
    for pattern, to in SECRETS:
        text = F.regexp_replace(text, pattern, to)
    return text


def like_escaped(term: str) -> str:
    """A LIKE operand in which the wildcards of term stand for themselves."""
    for c in ("\\", "%", "_"):
        term = term.replace(c, "\\" + c)
    return term


def unit(value: Column) -> Column:
    """value kept within 0 and 1; NaN and null give 0."""
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
