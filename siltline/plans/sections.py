"""Object and string sections of replies; names that texts compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sections
from ..sources.tables import table
from .registry import query

#: Replies in all shapes by an arithmetic of the ids, alike for Spark and DuckDB.
_REPLY = """CASE (conv_id + turn) % 6 WHEN 0 THEN concat('{"company": {"name": "', md5(coalesce(text, '')), '"}, "markets": ["a", " ', role, ' "]}')
 WHEN 1 THEN concat('{"company": "x", "markets": ["', role, '", 3, "", null, {"a": 1}, " c"]}') WHEN 2 THEN '{"markets": "a"}'
 WHEN 3 THEN '{"company": [1], "markets": {"a": 1}}' WHEN 4 THEN '{"company"' ELSE '{"company": null, "markets": []}' END"""


@query(
    "section_values",
    f"""WITH r AS (SELECT conv_id, turn, CASE WHEN json_valid({_REPLY}) THEN {_REPLY} ELSE '0' END AS j FROM conversations),
k AS (SELECT conv_id, turn, j, coalesce(json_type(j, '$.company'), 'NULL') AS o, coalesce(json_type(j, '$.markets'), 'NULL') AS a FROM r),
m AS (SELECT *, CASE WHEN a = 'ARRAY' THEN json_extract(j, '$.markets[*]') ELSE [] END AS items FROM k),
s AS (SELECT *, list_filter(list_transform(list_filter(items, lambda v: json_type(v) = 'VARCHAR'), lambda v: trim(json_extract_string(v, '$'))), lambda x: x <> '') AS kept FROM m)
SELECT conv_id, turn, CASE o WHEN 'NULL' THEN 'absent' WHEN 'OBJECT' THEN 'ok' ELSE 'wrong shape' END AS company, json_extract_string(j, '$.company.name') AS name,
 CASE WHEN a = 'NULL' THEN 'absent' WHEN a <> 'ARRAY' THEN 'wrong shape' WHEN len(kept) = len(items) THEN 'ok' ELSE 'incomplete' END AS markets, array_to_string(kept, '|') AS kept FROM s""",
)
def section_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section of a reply by itself: one that is missing or misshapen spoils no other."""
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_REPLY).alias("reply"))
    company, markets = sections.section("reply", "company"), sections.section("reply", "markets")
    return r.select(
        "conv_id", "turn", sections.object_status(company).alias("company"), F.try_variant_get(company, "$.name", "string").alias("name"),
        sections.strings_status(markets).alias("markets"), F.array_join(sections.kept_strings(markets), "|").alias("kept"),
    )


_SAID = """concat(coalesce(text, ''), CASE doc_id % 5 WHEN 0 THEN ' Alternatives to Xero. Plans from 5. We beat it, compared with Fresh-Books.io Our tool'
 WHEN 1 THEN ' acme VS. The Rest; vs Big Corp, alternative to B and vs Big Corp' WHEN 2 THEN concat(' switching  from Tool', CAST(doc_id % 30 AS VARCHAR(20)), ' Compare To Élan vs Q&A Desk-')
 WHEN 3 THEN ' compared to lower case, canvs Name' ELSE '' END)"""
_FOUND = " UNION ALL ".join(f"SELECT doc_id, trim(unnest(regexp_extract_all(x, '{sections.pattern(p)}', 1)), '{sections.EDGES}') AS n FROM t" for p in sections.PHRASES)
_NO_NAME = ", ".join(f"'{w}'" for w in sections.NO_NAME)


@query(
    "compared_names",
    f"""WITH t AS (SELECT doc_id, {_SAID} AS x FROM documents), f AS ({_FOUND}), w AS (SELECT doc_id, regexp_split_to_array(n, '\\s+') AS w FROM f),
c AS (SELECT doc_id, CASE WHEN len(w) > 1 AND lower(w[-1]) IN ({_NO_NAME}) THEN w[:1] ELSE w END AS w FROM w)
SELECT DISTINCT doc_id, array_to_string(w, ' ') AS name FROM c WHERE lower(w[1]) NOT IN ({_NO_NAME}) AND length(array_to_string(w, ' ')) > 1""",
)
def compared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that whole texts compare with, each once a text; found within the text's row."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SAID).alias("x"))
    return t.select("doc_id", F.explode(sections.compared("x")).alias("name"))
