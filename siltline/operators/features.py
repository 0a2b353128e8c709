"""Bounded features and the pre-score of a lead, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACE, keyword_normal, unit

#: Its end of a word is stated, as engines differ in what letters \b knows.
QUESTION = (
    rf"\?|^{SPACE}*(?:who|what|when|where|why|how|which|is|are|does|do|did|can|could|should|would|will|has|have|any|anyone|anybody|looking{SPACE}+for{SPACE}+advice)"
    r"(?:[^\p{L}\p{N}_]|$)"
)
#: Component weights; they are divided by their sum.
WEIGHTS = {"tier": 0.05, "density": 0.05, "question": 0.03, "recency": 0.07, "engagement": 0.05, "length": 0.03}
LENGTH_FULL, UPVOTES_FULL, COMMENTS_FULL = 1500, 100, 50


def tier_hits(text: Column, tiers: dict[str, tuple[str, ...]], normal: bool = False) -> dict[str, Column]:
    """For each tier the array of its phrases that occur in text as normalised words."""
    norm = text if normal else keyword_normal(text)
    return {
        t: F.array_compact(F.array(*(F.when(F.contains(norm, keyword_normal(F.lit(p))), F.lit(p)) for p in phrases)))
        for t, phrases in tiers.items()
    }


def tier_value(hits: dict[str, Column], decay: float = 2.0) -> Column:
    """1 for a hit in the first tier, divided by decay for each tier below it; 0 without hits."""
    return F.coalesce(*(F.when(F.size(h) > 0, decay**-i) for i, h in enumerate(hits.values())), F.lit(0.0))


def density(hits: dict[str, Column]) -> Column:
    return F.least(sum((F.size(h) for h in hits.values()), F.lit(0)) / 3.0, F.lit(1.0))


def question(title: Column) -> Column:
    return F.when(title.rlike("(?iu)" + QUESTION), 1.0).otherwise(0.0)


def recency(age_hours: Column, window_days: int = 30) -> Column:
    """Halves every half window; future posts count 1, unknown times 0."""
    if window_days <= 0:
        return F.lit(0.0)
    return unit(F.pow(F.lit(0.5), F.greatest(age_hours, F.lit(0)) / 24.0 / (window_days / 2)))


def engagement(score: Column, comments: Column) -> Column:
    """Mean of the known ones of two saturating parts; 0 where neither is known."""
    parts = [unit(score / UPVOTES_FULL), unit(comments / COMMENTS_FULL)]
    known = [score.isNotNull(), comments.isNotNull()]
    n = sum((k.cast("int") for k in known), F.lit(0))
    total = sum((F.when(k, p).otherwise(0.0) for k, p in zip(known, parts, strict=True)), F.lit(0.0))
    return F.when(n > 0, total / n).otherwise(0.0)


def length_value(n: Column, least: int) -> Column:
    if least >= LENGTH_FULL:
        return F.when(n < least, 0.0).otherwise(1.0)
    return F.when(n < least, 0.0).otherwise(unit((n - least) / float(LENGTH_FULL - least)))


def components(tiers: dict[str, tuple[str, ...]], least: int, window_days: int, norm: str) -> dict[str, Column]:
    """The components of a lead; norm names a column with the normalised title and body."""
    hits = tier_hits(F.col(norm), tiers, normal=True)
    return {
        "tier": tier_value(hits),
        "density": density(hits),
        "question": question(F.col("title")),
        "recency": recency(F.col("age_hours"), window_days),
        "engagement": engagement(F.col("score"), F.col("num_comments")),
        "length": length_value(F.length(F.concat(F.col("title"), F.col("body"))), least),
    }


def prescore(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """100 times the weighted mean of the components."""
    total = sum(weights.values())
    return 100.0 * sum((parts[k] * (w / total) for k, w in weights.items()), F.lit(0.0))


def intent_score(high: tuple[str, ...], medium: tuple[str, ...]) -> Column:
    """The older additive score: keywords, votes, comments and hours, each with its weight."""
    text = F.lower(F.concat_ws(" ", F.col("title"), F.col("body")))
    count = lambda ks: sum((F.contains(text, F.lit(k)).cast("int") for k in ks), F.lit(0))
    votes = F.least(F.coalesce("score", F.lit(0)), F.lit(100)) * 0.1
    comments = F.least(F.coalesce("num_comments", F.lit(0)), F.lit(50)) * 0.2
    fresh = F.greatest(F.lit(0), 100 - F.col("age_hours")) * 5.0 / 100
    return count(high) * 20.0 + count(medium) * 10.0 + votes + comments + fresh
