"""Feeds, model replies and prompt chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.replies import outcome, padded, salvaged, token_estimate
from ..sources import atom
from ..sources.tables import LEADS_SQL, NOW, leads, table
from .registry import query

#: White space and control characters that XML cannot carry become one space.
_CONTROL = r"[\x00-\x20]+"


def _flat(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_CONTROL}', ' ', 'g'))"


@query(
    "atom_posts",
    f"""WITH {LEADS_SQL} SELECT 't3_' || id AS id, md5({_flat("title")}) AS title, coalesce(author, '[deleted]') AS author, coalesce(subreddit, '') AS subreddit,
 'https://www.reddit.com/r/x/comments/' || id AS url, CASE WHEN id % 10 = 0 THEN 0 ELSE least(length({_flat("body")}), 5000) END AS body_chars,
 md5(CASE WHEN id % 10 = 0 THEN '' ELSE substr({_flat("body")}, 1, 5000) END) AS body,
 strftime(TIMESTAMP '{NOW}' - to_hours(CAST(age_hours AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS created, CAST(NULL AS BIGINT) AS score FROM leads WHERE id % 13 <> 0""",
)
def atom_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post written as an Atom feed and read back: entries without content or id among them."""
    def flat(c):
        return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _CONTROL, " "))

    def escaped(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    stamp = F.expr(f"date_format(timestampadd(HOUR, CAST(-age_hours AS INT), TIMESTAMP_NTZ'{NOW}'), \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\")")
    inner = F.concat(F.lit('<div class="md"><p>'), escaped(flat(F.col("body"))), F.lit("</p></div><p>submitted by someone</p>"))
    content = F.when(F.col("id") % 10 == 0, "").otherwise(F.concat(F.lit('<content type="html">'), escaped(inner), F.lit("</content>")))
    xml = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><author><name>'), F.concat(F.lit("/u/"), F.coalesce("author", F.lit(""))),
        F.lit('</name></author><category term="'), escaped(F.coalesce("subreddit", F.lit(""))), F.lit('"/>'), content,
        F.lit("<id>"), F.when(F.col("id") % 13 == 0, "broken").otherwise(F.concat(F.lit("t3_"), "id")),
        F.lit('</id><link href="https://old.reddit.com/r/x/comments/'), F.col("id").cast("string"), F.lit('"/><published>'), stamp,
        F.lit("</published><title>"), escaped(flat(F.col("title"))), F.lit("</title></entry></feed>"),
    )
    p = atom.posts(leads(spark, sf_dir).select(xml.alias("xml")))
    return p.select("id", F.md5("title").alias("title"), "author", "subreddit", "url", F.length("body").cast("long").alias("body_chars"), F.md5("body").alias("body"), "created", "score")


_OUTCOME = "CASE WHEN (conv_id + turn) % 6 = 3 THEN 'empty' WHEN (conv_id + turn) % 6 = 4 THEN 'invalid_json' WHEN (conv_id + turn) % 6 = 5 OR conv_id % 12 > 10 THEN 'schema_error' ELSE 'ok' END"


@query(
    "reply_repair",
    f"""SELECT conv_id, turn, {_OUTCOME} AS outcome, CASE WHEN {_OUTCOME} = 'ok' THEN md5(coalesce(text, '')) END AS quote FROM conversations WHERE role = 'assistant'""",
)
def reply_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant texts as replies that are plain, fenced, in prose, blank, cut or short of a field."""
    form = (F.col("conv_id") + F.col("turn")) % 6
    quote = F.coalesce("text", F.lit(""))
    whole = F.to_json(F.struct(quote.alias("quote"), (F.col("conv_id") % 12).alias("score")))
    reply = (
        F.when(form == 0, whole)
        .when(form == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("Here it is: "), whole, F.lit(" Anything {else}?")))
        .when(form == 3, " \n ")
        .when(form == 4, F.expr("left(w, length(w) - 1)"))
        .otherwise(F.to_json(F.struct(quote.alias("quote"))))
    )
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("w", whole).select("conv_id", "turn", reply.alias("reply"))
    said = said.withColumn("found", salvaged("reply")).withColumn("v", F.from_json("found", "quote string, score int"))
    valid = F.col("v.quote").isNotNull() & F.col("v.score").between(0, 10)
    done = said.withColumn("outcome", outcome(F.col("reply"), F.col("found"), valid))
    return done.select("conv_id", "turn", "outcome", F.when(F.col("outcome") == "ok", F.md5("v.quote")).alias("quote"))


@query(
    "prompt_chunks",
    """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x, greatest(1, length(coalesce(text, '')) // 4) AS n FROM conversations)
SELECT conv_id, turn, n AS tokens, CASE WHEN n % 64 = 0 THEN length(x) ELSE length(x) + (64 - n % 64) * 4 END AS padded_chars FROM t""",
)
def prompt_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of a text and its length once filled up to whole cache chunks."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", token_estimate(text).alias("tokens"), F.length(padded(text)).cast("long").alias("padded_chars"))


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-'{1}), '-')"


@query(
    "section_items",
    f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages),
s AS (SELECT page_id, list_transform(hs, lambda h: {_SLUG.format("h", ", 'g'")}) AS ss FROM l),
v AS (SELECT page_id, len(ss) AS given, list_sort(list_distinct(list_filter(ss, lambda x: regexp_full_match(x, '[a-z0-9]+(-[a-z0-9]+)*')))) AS items FROM s)
SELECT page_id, CAST(given AS BIGINT) AS given, CAST(len(items) AS BIGINT) AS kept, md5(array_to_string(items, ',')) AS items, CASE WHEN len(items) = given AND given BETWEEN 1 AND 20 THEN 'ok' ELSE 'incomplete' END AS status FROM v""",
)
def section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's links as a section's items: bad and repeated slugs go, bounds decide its status."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'))
    slugs = F.transform(found, lambda h: F.btrim(F.regexp_replace(F.lower(h), "[^a-z0-9]+", "-"), F.lit("-")))
    p = table(spark, sf_dir, "pages").select("page_id", slugs.alias("ss"))
    items = F.array_sort(F.array_distinct(F.filter("ss", lambda x: x.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"))))
    p = p.select("page_id", F.size("ss").cast("long").alias("given"), items.alias("items"))
    ok = (F.size("items") == F.col("given")) & F.col("given").between(1, 20)
    return p.select("page_id", "given", F.size("items").cast("long").alias("kept"), F.md5(F.array_join("items", ",")).alias("items"), F.when(ok, "ok").otherwise("incomplete").alias("status"))
