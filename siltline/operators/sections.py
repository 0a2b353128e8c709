"""Sections of a model's reply, each judged by itself, and names in phrases of comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A name is one or two capitalised words, inner dots allowed; the phrases before it.
_WORD = r"[\p{L}\p{N}_&-]"
_PART = rf"[A-Z]{_WORD}*(?:\.{_WORD}+)*"
NAME = rf"{_PART}(?:\s+{_PART})?"
PHRASES = (r"vs\.?", r"alternatives?\s+to", r"compared?\s+(?:to|with)", r"switch(?:ing|ed)?\s+from")
# Capitalised at a sentence's start, yet never a name.
NO_NAME = (
    "a all an and any as but each every for how if in it its many more most no not of one or other others our some "
    "that the their them these they this those to us we what when which who why you your"
).split()
EDGES = " .,;:-&"


def pattern(phrase: str) -> str:
    return rf"\b(?i:{phrase})\s+({NAME})"


def compared(text: str) -> Column:
    """Distinct names that a text compares with, phrase by phrase in the order found."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(pattern(p))) for p in PHRASES)))
    words = F.transform(found, lambda n: F.split(F.btrim(n, F.lit(EDGES)), r"\s+"))
    words = F.transform(words, lambda w: F.when(F.lower(F.element_at(w, -1)).isin(NO_NAME) & (F.size(w) > 1), F.slice(w, 1, 1)).otherwise(w))
    words = F.filter(words, lambda w: ~F.lower(F.element_at(w, 1)).isin(NO_NAME))
    names = F.transform(words, lambda w: F.array_join(w, " "))
    return F.array_distinct(F.filter(names, lambda n: F.length(n) > 1))


def _kind(part: Column) -> Column:
    """First word of a variant's type; null and JSON null are VOID."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(part), "^[A-Z]+", 0), F.lit("VOID"))


def section(reply: str, key: str) -> Column:
    """A part of a reply as a variant; null where it is missing or the reply is no JSON."""
    return F.try_variant_get(F.try_parse_json(F.col(reply)), f"$.{key}", "variant")


def object_status(part: Column) -> Column:
    kind = _kind(part)
    return F.when(kind == "VOID", "absent").when(kind == "OBJECT", "ok").otherwise("wrong shape")


def kept_strings(part: Column) -> Column:
    """Trimmed strings of an array part; other entries go, other shapes have none."""
    items = F.try_variant_get(part, "$", "array<variant>")
    texts = F.transform(F.filter(items, lambda v: _kind(v) == "STRING"), lambda v: F.trim(F.try_variant_get(v, "$", "string")))
    return F.coalesce(F.filter(texts, lambda x: x != ""), F.array().cast("array<string>"))


def strings_status(part: Column) -> Column:
    """ok only where the part is an array that lost no entry."""
    kind, given = _kind(part), F.size(F.try_variant_get(part, "$", "array<variant>"))
    return F.when(kind == "VOID", "absent").when(kind != "ARRAY", "wrong shape").when(F.size(kept_strings(part)) == given, "ok").otherwise("incomplete")
