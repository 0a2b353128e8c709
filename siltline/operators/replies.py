"""Model replies: what JSON a reply holds and what is wrong with one that holds none."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCED = re.compile(r"\s*```(?:\w+)?\s*\n(.*)\n\s*```\s*", re.S)
_DECODER = json.JSONDecoder()


def json_object(text: str | None) -> str | None:
    """The reply's JSON object as written, without a fence or prose around it; else None."""
    fenced = _FENCED.fullmatch(text or "")
    text = fenced[1] if fenced else text or ""
    start = text.find("{")
    if start < 0:
        return None
    try:
        _, end = _DECODER.raw_decode(text, start)
    except ValueError:
        return None
    return text[start:end]


@F.pandas_udf(StringType())
def salvaged(reply: pd.Series) -> pd.Series:
    return reply.map(json_object)


def outcome(reply: Column, found: Column, valid: Column) -> Column:
    """empty, invalid_json, schema_error or ok; found: the salvaged object, valid: its check."""
    blank = reply.isNull() | (F.trim(F.regexp_replace(reply, r"\s+", " ")) == "")
    return F.when(blank, "empty").when(found.isNull(), "invalid_json").when(F.coalesce(valid, F.lit(False)), "ok").otherwise("schema_error")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def padded(text: Column, chunk: int = 64) -> Column:
    """text filled up with a line of dots to a whole number of chunk tokens."""
    over = token_estimate(text) % chunk
    dots = F.repeat(F.lit("."), ((chunk - over) * 4 - 1).cast("int"))
    return F.when(over == 0, text).otherwise(F.concat(text, F.lit("\n"), dots))
