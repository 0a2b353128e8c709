"""Incoming posts: lists of communities and keywords, batches by community, scrapes and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, latest
from ..sources.tables import LEADS_SQL, leads, table
from .registry import query
from .scoring import TIERS, TRIAGE_SQL, _kw, triaged

#: Communities as a request writes them.
_WANTED = "CASE WHEN length(source) % 2 = 0 THEN concat('/r/', upper(source), '/') ELSE concat(' r/', source, ' ') END"


@query(
    "feed_names",
    f"""WITH n AS (SELECT doc_id, trim(trim({_WANTED}), '/') AS x FROM documents WHERE source IS NOT NULL)
SELECT doc_id, CASE WHEN lower(substr(x, 1, 2)) = 'r/' THEN substr(x, 3) ELSE x END AS name FROM n""",
)
def feed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community names without slashes and prefix; blank ones are dropped, repeats stay."""
    x = F.btrim(F.btrim(F.expr(_WANTED)), F.lit("/"))
    name = F.when(F.lower(F.substring(x, 1, 2)) == "r/", F.substring(x, 3, 10**6)).otherwise(x)
    return table(spark, sf_dir, "documents").where("source is not null").select("doc_id", name.alias("name")).where("name <> ''")


@query(
    "community_batches",
    f"WITH {LEADS_SQL}, w AS (SELECT upper(source) AS wanted, lower(source) AS k FROM documents WHERE source IS NOT NULL AND doc_id % 3 = 0 GROUP BY source) SELECT wanted, count(*) AS n, min(id) AS first FROM leads JOIN w ON lower(subreddit) = k GROUP BY wanted",
)
def community_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by the requested community whose name they match in any case; others are dropped."""
    wanted = table(spark, sf_dir, "documents").where("source is not null and doc_id % 3 = 0").select(F.upper("source").alias("wanted"), F.lower("source").alias("k")).distinct()
    posts = leads(spark, sf_dir).select("id", F.lower("subreddit").alias("k"))
    return posts.join(wanted, "k").groupBy("wanted").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("known_communities", "SELECT DISTINCT lower(x) AS name FROM (SELECT source AS x FROM documents UNION ALL SELECT n_name FROM nation) WHERE x IS NOT NULL")
def known_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured and the stored communities as one list."""
    both = table(spark, sf_dir, "documents").select(F.lower("source").alias("name")).union(table(spark, sf_dir, "nation").select(F.lower("n_name")))
    return both.where("name is not null").distinct()


@query(
    "keyword_lists",
    "SELECT DISTINCT CASE WHEN r_regionkey % 2 = 0 THEN 'high' ELSE 'medium' END AS tier, lower(CASE WHEN strpos(k, ':') > 0 THEN substr(k, strpos(k, ':') + 1) ELSE k END) AS keyword FROM (SELECT n_regionkey AS r_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'geo:' || n_name ELSE n_name END AS k FROM nation UNION ALL SELECT r_regionkey, r_name FROM region)",
)
def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each tier from two lists, without the part before a colon."""
    named = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("geo:"), "n_name")).otherwise(F.col("n_name"))
    both = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), named.alias("k")).union(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return both.select(F.when(F.col("r") % 2 == 0, "high").otherwise("medium").alias("tier"), F.lower(F.regexp_replace("k", "^[^:]*:", "")).alias("keyword")).distinct()


DEFAULTS = {"keyword_weight": 3.0, "upvote_weight": 1.0, "comment_weight": 2.0, "recency_weight": 1.5}
_defaults = ", ".join(f"('{k}', {v}::DOUBLE, {i})" for i, (k, v) in enumerate(DEFAULTS.items()))


@query(
    "setting_values",
    f"""WITH d(name, fallback, i) AS (VALUES {_defaults}), s AS (SELECT n_nationkey % 7 AS i, min(n_nationkey) AS at, arg_min(n_regionkey, n_nationkey) AS v FROM nation WHERE n_nationkey % 7 < 2 GROUP BY 1), c AS (SELECT r_regionkey AS i, length(r_name) AS v FROM region WHERE r_regionkey IN (1, 2))
SELECT name, CAST(coalesce(s.v, c.v, fallback) AS DOUBLE) AS value FROM d LEFT JOIN s USING (i) LEFT JOIN c USING (i)""",
)
def setting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each setting from the stored rows (the first of a key), else the configuration, else its default."""
    names = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("fallback"), F.lit(i).alias("i")) for i, (k, v) in enumerate(DEFAULTS.items())))
    d = table(spark, sf_dir, "region").limit(1).select(F.inline(names))
    s = table(spark, sf_dir, "nation").where("n_nationkey % 7 < 2").groupBy((F.col("n_nationkey") % 7).alias("i")).agg(F.min_by("n_regionkey", "n_nationkey").alias("s"))
    c = table(spark, sf_dir, "region").where("r_regionkey in (1, 2)").select(F.col("r_regionkey").alias("i"), F.length("r_name").alias("c"))
    return d.join(s, "i", "left").join(c, "i", "left").select("name", F.coalesce(F.col("s").cast("double"), F.col("c").cast("double"), "fallback").alias("value"))


_words = TIERS["high"] + TIERS["medium"]
_intent = f"CAST(round(({_kw(TIERS['high'])}) * 20.0 + ({_kw(TIERS['medium'])}) * 10.0 + least(coalesce(score, 0), 100) * 0.1 + least(coalesce(num_comments, 0), 50) * 0.2 + greatest(0, 100 - age_hours) * 5.0 / 100, 2) AS DOUBLE)"


def _wanted(least: float):
    text = F.lower(F.concat_ws(" ", "title", "body"))
    words = reduce(lambda a, b: a + b, [F.contains(text, F.lit(k)).cast("int") for k in _words])
    score = F.round(features.intent_score(TIERS["high"], TIERS["medium"]), 2)
    return score, (score >= least) & (words > 0)


@query(
    "community_scrape",
    f"""WITH {LEADS_SQL}, x AS (SELECT *, lower(title || ' ' || body) AS t FROM leads WHERE subreddit IS NOT NULL AND id NOT IN (SELECT doc_id FROM labels)), s AS (SELECT id, subreddit, {_intent} AS intent, ({_kw(_words)}) > 0 AS has FROM x)
SELECT subreddit, count(*) AS seen, count(*) FILTER (intent >= 3 AND has) AS kept, CAST(round(max(intent) FILTER (intent >= 3 AND has), 2) AS DOUBLE) AS best FROM s GROUP BY subreddit""",
)
def community_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New posts by community: seen, kept as leads (a score of three or more and a keyword), best score."""
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    score, good = _wanted(3)
    new = leads(spark, sf_dir).where("subreddit is not null").join(stored, "id", "left_anti").select("subreddit", score.alias("intent"), good.alias("good"))
    return new.groupBy("subreddit").agg(F.count("*").alias("seen"), F.count_if("good").alias("kept"), F.max(F.when(F.col("good"), F.col("intent"))).alias("best"))


@query(
    "keyword_scrape",
    f"""WITH {LEADS_SQL}, q(q) AS (VALUES ('the'), ('de'), ('zz zz')), x AS (SELECT l.*, q, lower(title || ' ' || body) AS t FROM leads l JOIN q ON contains(lower(title), q) WHERE subreddit IS NOT NULL),
f AS (SELECT id, subreddit, min(q) AS found_by FROM (SELECT *, {_intent} AS intent, ({_kw(_words)}) > 0 AS has FROM x) WHERE intent >= 5 AND has GROUP BY ALL) SELECT id, subreddit, found_by FROM f""",
)
def keyword_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of every community whose title holds a search term, once each, with a score of five or more."""
    terms = F.array(*map(F.lit, ("the", "de", "zz zz")))
    score, good = _wanted(5)
    hit = F.filter(terms, lambda q: F.contains(F.lower("title"), q))
    found = leads(spark, sf_dir).where("subreddit is not null").select("id", "subreddit", F.array_min(hit).alias("found_by"), good.alias("good"))
    return found.where("good and found_by is not null").select("id", "subreddit", "found_by")


@query(
    "author_scrape",
    f"WITH {LEADS_SQL}, u AS (SELECT 'user' || s_suppkey % 97 AS author FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1) SELECT author, count(*) AS posts, count(DISTINCT subreddit) AS communities, CAST(sum(coalesce(score, 0)) AS BIGINT) AS votes FROM leads JOIN u USING (author) GROUP BY author",
)
def author_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the authors that are followed, with counters."""
    followed = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("user"), (F.col("s_suppkey") % 97).cast("string")).alias("author")).distinct()
    return leads(spark, sf_dir).join(followed, "author").groupBy("author").agg(
        F.count("*").alias("posts"), F.countDistinct("subreddit").alias("communities"), F.sum(F.coalesce("score", F.lit(0))).alias("votes")
    )


@query("triage_totals", f"WITH {LEADS_SQL}, {TRIAGE_SQL} SELECT count(*) FILTER (t_reason IS NULL) AS admitted, count(t_reason) AS rejected, count(DISTINCT t_reason) AS reasons FROM triaged")
def triage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triaged(leads(spark, sf_dir)).agg(F.count_if(F.col("t_reason").isNull()).alias("admitted"), F.count("t_reason").alias("rejected"), F.countDistinct("t_reason").alias("reasons"))


@query("lead_feed", f"""WITH {LEADS_SQL} SELECT id, '{{"id":' || id || ',"subreddit":"' || subreddit || '","score":' || coalesce(CAST(score AS VARCHAR), 'null') || ',"comments":' || coalesce(num_comments, 0) || '}}' AS entry FROM leads WHERE subreddit IS NOT NULL ORDER BY id DESC LIMIT 100""")
def lead_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred leads as JSON; unknown votes stay null."""
    entry = F.struct("id", "subreddit", "score", F.coalesce("num_comments", F.lit(0)).alias("comments"))
    page = latest.page(leads(spark, sf_dir).where("subreddit is not null"), 1, 100, F.desc("id"))
    return page.select("id", F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))


@query("plain_search", f"WITH {LEADS_SQL} SELECT count(*) AS n FROM leads WHERE title ILIKE '%1__%' OR body ILIKE '%1__%'")
def plain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search whose wildcards count as such."""
    return leads(spark, sf_dir).where(F.col("title").ilike("%1__%") | F.col("body").ilike("%1__%")).agg(F.count("*").alias("n"))


