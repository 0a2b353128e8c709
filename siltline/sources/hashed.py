"""Posts with the hash of their normalised title and body, and the SQL of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE_RE2, content_hash
from .tables import LEADS_SQL, leads

_S = SPACE_RE2


def _cut(x: str) -> str:
    lines = f"string_split({x}, chr(10))"
    marks = f"list_position(list_transform({lines}, lambda l: regexp_matches(l, '(?i)^{_S}*(edit|update)([^\\pL\\pN_]|$)')), true)"
    return f"CASE WHEN coalesce({marks}, 0) > 0 THEN array_to_string({lines}[1:coalesce({marks}, 0) - 1], chr(10)) ELSE {x} END"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower({_cut(x)}), 'ß', 'ss'), '[*_~`]', '', 'g'), '{_S}+', ' ', 'g'))"


HASHED_SQL = f"{LEADS_SQL}, hashed AS (SELECT *, sha256({norm_sql('title')} || chr(10) || {norm_sql('body')}) AS hash FROM leads)"


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).withColumn("hash", content_hash(F.col("title"), F.col("body")))
