"""The rule engine: ordered rejections as one CASE chain over a post's columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound, keyword_normal

# Fixed values of the rule engine.
BOT_AUTHORS = ("automoderator", "autotldr", "remindmebot", "sneakpeekbot", "totesmessenger", "wikitextbot", "imagesofnetwork", "savevideo")
DELETED_AUTHORS = ("[deleted]", "[removed]")
HIRING = r"^\s*\[\s*(?:hiring|for\s+hire)\s*\]|\bwe(?:'|’)?re hiring\b|\bnow hiring\b|\bjob (?:opening|posting)\b"
STRUCTURAL = (
    (HIRING, "hiring"),
    (r"\bgiveaway\b|\bfree (?:copy|licen[sc]e|key)s?\b|\braffle\b", "giveaway"),
    (r"\bmegathread\b|\bweekly (?:thread|discussion)\b|\bmonthly thread\b|\bdaily (?:thread|discussion)\b", "megathread"),
    (r"^\s*(?:\[\s*)?ama\b\s*\]?|\bask me anything\b", "ama"),
    (r"\bpromo(?:tional)? code\b|\bdiscount code\b|\buse code\s+\w+|\baffiliate link\b|\bupvote (?:this )?if\b", "promo"),
)
TRIAGE = (
    (HIRING, "hiring"),
    (r"\bgiveaway\b|\bfree (?:copy|license|licence)s?\b", "giveaway"),
    (r"\bmegathread\b|\bweekly (?:thread|discussion)\b|\bmonthly thread\b", "megathread"),
    (r"^\[?ama\]?\b|\bask me anything\b", "ama"),
    (r"\bupvote\b.*\bif\b|\bkarma\b", "engagement_bait"),
)


def first_of(*cases: tuple[Column, Column]) -> Column:
    """The value of the first case whose condition holds, else null."""
    return F.coalesce(*(F.when(c, v) for c, v in cases))


def check_author(author: Column, allowed: tuple[str, ...] = ()) -> Column:
    """bot_or_deleted's detail (deleted, known_bot, bot_suffix) or null; blank authors pass."""
    name = F.btrim(F.coalesce(author, F.lit("")))
    low = F.lower(name)
    suffix = name.endswith("Bot") | reduce(lambda a, b: a | b, [low.endswith(s) for s in ("_bot", "-bot", ".bot")])
    verdict = first_of(
        (low.isin(*DELETED_AUTHORS), F.lit("deleted")), (low.isin(*BOT_AUTHORS), F.lit("known_bot")), (suffix, F.lit("bot_suffix"))
    )
    return F.when(~low.isin(*[a.lower() for a in allowed]), verdict) if allowed else verdict


def check_structural(title: Column, patterns: tuple[tuple[str, str], ...] = STRUCTURAL) -> Column:
    """The kind of noise that a title is, or null."""
    return first_of(*((title.rlike("(?i)" + p), F.lit(kind)) for p, kind in patterns))


def check_negative(text: Column, terms: tuple[str, ...]) -> Column:
    """The first term, in the given order, that occurs in text as normalised words."""
    if not terms:
        return F.lit(None).cast("string")
    return bound(keyword_normal(text), lambda norm: first_of(*((F.contains(norm, keyword_normal(F.lit(t))), F.lit(t)) for t in terms)))


def check_length(text: Column, least: int) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < least, F.concat(n.cast("string"), F.lit(f" < {least}")))


def hard_filter(least: int, terms: tuple[str, ...], window_days: int) -> Column:
    """A struct (reason, detail) of the first rejection of a lead; null for an admitted one."""
    text = F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("body"), F.lit("")))
    checks = (
        ("out_of_window", F.when(F.col("age_hours") > 24 * window_days, F.lit("age"))),
        ("bot_or_deleted", check_author(F.col("author"))),
        ("structural_noise", check_structural(F.col("title"))),
        ("negative_term", check_negative(F.concat_ws("\n", F.col("title"), text), terms)),
        ("too_short", check_length(text, least)),
    )
    told = lambda reason: lambda d: F.when(d.isNotNull(), F.struct(F.lit(reason).alias("reason"), d.alias("detail")))
    return F.coalesce(*(bound(d, told(r)) for r, d in checks))


def triage(terms: tuple[str, ...], keywords: tuple[str, ...], window_days: int) -> tuple[Column, Column]:
    """(reason or null, provisional score) from a lead's metadata alone."""
    title = F.btrim(F.col("title"))
    low = F.lower(title)
    reason = first_of(
        (title == "", F.lit("no_title")),
        (F.lower(F.btrim(F.coalesce("author", F.lit("")))).isin(*BOT_AUTHORS), F.lit("bot_author")),
        *((title.rlike("(?i)" + p), F.lit(kind)) for p, kind in TRIAGE),
        (F.col("age_hours") > 24 * window_days, F.lit("out_of_window")),
        *((F.contains(low, F.lit(t.lower())), F.lit("negative_term")) for t in terms),
    )
    hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(k.lower())).cast("int") for k in keywords])
    return reason, F.when(reason.isNull(), F.least(hits, F.lit(5)) * 20.0).otherwise(0.0)


# Fixed values of the gate: metadata reasons in its vocabulary, and reasons that are never sampled.
TO_GATE = {
    "no_title": "too_short",
    "bot_author": "bot_or_deleted",
    "hiring": "structural_noise",
    "giveaway": "structural_noise",
    "megathread": "structural_noise",
    "ama": "structural_noise",
    "engagement_bait": "structural_noise",
    "out_of_window": "out_of_window",
    "negative_term": "negative_term",
}
NEVER_SAMPLED = ("already_analyzed", "duplicate_exact", "duplicate_near", "budget_exhausted", "no_title")


def to_gate(reason: Column) -> Column:
    return F.coalesce(first_of(*((reason == k, F.lit(v)) for k, v in TO_GATE.items())), reason)
