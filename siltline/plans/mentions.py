"""Names that posts mention, and cache identities of texts and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE_RE2, cache_normal, keyword_normal
from ..sources.shared import written
from ..sources.tables import LEADS_SQL, leads, table
from .registry import query
from .scoring import _norm, _quoted

#: The registry of the queries: canonical names with their aliases, in the order registered.
REGISTRY = {"This": ("this is",), "With": (), "From": ("from the", "from a"), "Licence": ("license", "all rights"), "Nobody": ("zz zz",)}
_WORD = r"\p{L}\p{N}_"


def mentioned(text: Column, registry: dict[str, tuple[str, ...]]) -> Column:
    """The registered names that text mentions as whole words, in registered order, each once."""
    if not registry:
        return F.array().cast("array<string>")

    def names(norm: Column) -> Column:
        found = []
        for name, aliases in registry.items():
            needles = [x for x in (" ".join(s.lower().split()) for s in (name, *aliases)) if x]
            hits = [norm.rlike(rf"(^|[^{_WORD}])\Q{x}\E([^{_WORD}]|$)") for x in needles]
            found.append(F.when(reduce(lambda a, b: a | b, hits), F.lit(name)))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    # the one-element array binds the normalised text, so it is made once
    return F.get(F.transform(F.array(keyword_normal(text)), names), F.lit(0))


_hit = lambda x: f"regexp_matches(norm, '(^|[^\\pL\\pN_]){x}([^\\pL\\pN_]|$)')"
_names = ", ".join(f"CASE WHEN {' OR '.join(_hit(x.lower()) for x in (n, *a))} THEN {_quoted(n)} END" for n, a in REGISTRY.items())


@query(
    "entity_mentions",
    f"""WITH {LEADS_SQL}, n AS (SELECT id, {_norm("title || chr(10) || body")} AS norm FROM leads),
m AS (SELECT id, list_filter([{_names}], lambda x: x IS NOT NULL) AS names FROM n)
SELECT id, array_to_string(names, ',') AS names, CAST(len(names) AS BIGINT) AS n, len(names) > 0 AS any_name FROM m""",
)
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names in a post's title or body, how many, and whether there is any."""
    names = mentioned(F.concat_ws("\n", "title", "body"), REGISTRY)
    found = leads(spark, sf_dir).select("id", names.alias("names"))
    return found.select("id", F.array_join("names", ",").alias("names"), F.size("names").cast("long").alias("n"), (F.size("names") > 0).alias("any_name"))


@query("entity_counts", f"WITH {LEADS_SQL}, n AS (SELECT id, {_norm('title || chr(10) || body')} AS norm FROM leads), m AS (SELECT unnest(list_filter([{_names}], lambda x: x IS NOT NULL)) AS name FROM n) SELECT name, count(*) AS n FROM m GROUP BY name")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = mentioned(F.concat_ws("\n", "title", "body"), REGISTRY)
    return leads(spark, sf_dir).select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


_cached = lambda x: f"replace(lower(trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?is)\\n*{SPACE_RE2}*(edit|update){SPACE_RE2}*[0-9]*{SPACE_RE2}*:.*$', ''), '[*_~`]+', '', 'g'), '{SPACE_RE2}+', ' ', 'g'))), 'ß', 'ss')"
#: What belongs to a prompt's identity besides its texts.
PROMPT = ("local", "small-1", "score", "3")
_prompt = " || chr(31) || ".join(map(_quoted, PROMPT))


@query(
    "cache_keys",
    f"""WITH c AS (SELECT *, sha256({_cached("text")}) AS content FROM documents)
SELECT doc_id, content, sha256({_prompt} || chr(31) || coalesce(source, '') || chr(31) || coalesce(text, '')) AS key FROM c""",
)
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content identity (edits, emphasis and blanks do not count) and prompt identity of each text."""
    parts = [*map(F.lit, PROMPT), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))]
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(cache_normal(F.col("text")), 256).alias("content"), F.sha2(F.concat_ws("\x1f", *parts), 256).alias("key"))


@query("cache_stats", f"WITH c AS (SELECT sha256({_cached('text')}) AS content FROM documents) SELECT count(DISTINCT content) AS entries, count(*) - count(DISTINCT content) AS hits FROM c")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a content cache that sees every text once, and how often one is found."""
    per = table(spark, sf_dir, "documents").groupBy(F.sha2(cache_normal(F.col("text")), 256)).count()
    return per.agg(F.count("*").alias("entries"), F.sum(F.col("count") - 1).alias("hits"))


@query("single_flight", f"WITH c AS (SELECT doc_id, sha256({_cached('text')}) AS content FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY content) AS caller FROM c")
def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row asks for each content; rows with the same content wait for it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(cache_normal(F.col("text")), 256).alias("content"))
    rows = written(rows, "contents")  # texts are normalised once, and only hashes are dealt
    first = rows.groupBy(F.col("content").alias("same")).agg(F.min("doc_id").alias("caller"))
    return rows.join(first, F.col("content").eqNullSafe(F.col("same"))).select("doc_id", "caller")


#: Kinds of time-bound data and their patterns, in this order (fixed values).
VOLATILE = (
    ("timestamp", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"),
    ("uuid", r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    ("epoch", r"\b1[6-9]\d{8}\b"),
    ("run_or_job", r"(?i)\b(run|job)[_-]?id\W{0,3}\d+"),
)


@query("volatile_texts", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, {_quoted(p)}) THEN '{n}'" for n, p in VOLATILE) + " END AS kind FROM documents")
def volatile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first kind of time-bound data in a text that is to be a stable prefix; null if none."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in VOLATILE)).alias("kind"))


@query(
    "frozen_contexts",
    """WITH p AS (SELECT source, '## documents' || chr(10) || count(*) || chr(10) || chr(10) || '## languages' || chr(10) || '[' || string_agg(DISTINCT '"' || lang || '"', ',' ORDER BY '"' || lang || '"') || ']' AS t FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY source),
q AS (SELECT source, t || repeat(' ', CAST((256 - length(t) % 256) % 256 AS BIGINT)) AS t FROM p)
SELECT source, sha256(t) AS prefix_hash, CAST(greatest(1, length(t) // 4) AS BIGINT) AS tokens FROM q""",
)
def frozen_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's sections in name order as stable JSON, padded to whole chunks of 64 tokens."""
    rows = table(spark, sf_dir, "documents").where("lang is not null and source is not null").groupBy("source", "lang").count()
    per = rows.groupBy("source").agg(F.sum("count").alias("documents"), F.to_json(F.array_sort(F.collect_set("lang"))).alias("languages"))
    text = F.concat(F.lit("## documents\n"), F.col("documents").cast("string"), F.lit("\n\n## languages\n"), F.col("languages"))
    size = F.ceil(F.length(text) / 256) * 256
    per = per.select("source", F.rpad(text, size.cast("int"), F.lit(" ")).alias("t"))
    return per.select("source", F.sha2("t", 256).alias("prefix_hash"), F.greatest(F.lit(1), F.floor(F.length("t") / 4)).cast("long").alias("tokens"))
