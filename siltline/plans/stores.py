"""Store operators: semi and anti joins, first-wins unions, upserts, versions, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import latest
from ..sources.tables import EVENTS_SQL, LEADS_SQL, events, leads, table
from .registry import query


@query("existing_ids", f"WITH {LEADS_SQL} SELECT id FROM leads WHERE id IN (SELECT doc_id FROM labels)")
def existing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return leads(spark, sf_dir).select("id").join(stored, "id", "left_semi")


@query(
    "filter_new",
    f"""WITH {LEADS_SQL}, keyed AS (SELECT id, subreddit || ':' || title AS k FROM leads),
stored AS (SELECT k FROM keyed WHERE id % 10 = 3) SELECT min(id) AS id, k FROM keyed WHERE k NOT IN (SELECT k FROM stored) GROUP BY k""",
)
def filter_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """new_posts by whole titles."""
    return new_posts(leads(spark, sf_dir))


def new_posts(posts: DataFrame) -> DataFrame:
    """The first post of each subreddit and title that is not stored."""
    keyed = posts.select("id", F.concat("subreddit", F.lit(":"), "title").alias("k"))
    return latest.new_rows(keyed, keyed.where("id % 10 = 3"), "k", F.col("id"))


@query(
    "merge_first_wins",
    f"""WITH {LEADS_SQL} SELECT id, 'feed' AS origin, score FROM leads WHERE id % 3 <> 0
UNION ALL SELECT id, 'page', num_comments FROM leads WHERE id % 3 = 0 AND id % 2 = 0""",
)
def merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = leads(spark, sf_dir)
    feed = posts.where("id % 3 <> 0").select("id", F.lit("feed").alias("origin"), "score")
    other = posts.where("id % 2 = 0").select("id", F.lit("page").alias("origin"), F.col("num_comments").alias("score"))
    return latest.first_wins(feed, other, "id")


@query(
    "parity_compare",
    f"""WITH {LEADS_SQL}, l AS (SELECT id, score, lower(subreddit) AS sub FROM leads WHERE id % 4 <> 0), r AS (SELECT id, CASE WHEN id % 9 = 0 THEN score + 1 ELSE score END AS score, subreddit AS sub FROM leads WHERE id % 5 <> 0),
j AS (SELECT l.id AS a, r.id AS b, l.score IS NOT DISTINCT FROM r.score AS same, l.score IS NULL OR r.score IS NULL AS unknown FROM l FULL JOIN r ON l.id = r.id)
SELECT CASE WHEN b IS NULL THEN 'left_only' WHEN a IS NULL THEN 'right_only' WHEN same THEN 'equal' WHEN unknown THEN 'tolerated' ELSE 'mismatch' END AS verdict, count(*) AS n FROM j GROUP BY 1""",
)
def parity_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extracts by id: shared or one-sided rows, equal, tolerated or differing votes."""
    posts = leads(spark, sf_dir)
    a = posts.where("id % 4 <> 0").select(F.col("id").alias("a"), F.col("score").alias("x"))
    b = posts.where("id % 5 <> 0").select(F.col("id").alias("b"), F.expr("CASE WHEN id % 9 = 0 THEN score + 1 ELSE score END").alias("y"))
    verdict = (
        F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").when(F.col("x").eqNullSafe(F.col("y")), "equal")
        .when(F.col("x").isNull() | F.col("y").isNull(), "tolerated").otherwise("mismatch")
    )
    return a.join(b, F.col("a") == F.col("b"), "full_outer").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "backfill",
    f"WITH {LEADS_SQL} SELECT l.id, coalesce(l.score, b.quality) AS score, coalesce(l.num_comments, b.toxic) AS num_comments FROM leads l LEFT JOIN labels b ON b.doc_id = l.id",
)
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    joined = leads(spark, sf_dir).join(known, "id", "left")
    return joined.select("id", F.coalesce("score", "quality").alias("score"), F.coalesce("num_comments", "toxic").alias("num_comments"))


@query(
    "candidates",
    f"""WITH {LEADS_SQL}, c AS (SELECT conv_id, count(*) AS stored FROM conversations GROUP BY conv_id)
SELECT l.id, p.quality, l.num_comments, coalesce(c.stored, 0) AS stored FROM leads l JOIN labels p ON p.doc_id = l.id LEFT JOIN c ON c.conv_id = l.id""",
)
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("stored"))
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    joined = leads(spark, sf_dir).join(judged, "id").join(stored, "id", "left")
    return joined.select("id", "quality", "num_comments", F.coalesce("stored", F.lit(0)).alias("stored"))


@query(
    "upsert",
    """WITH o AS (SELECT DISTINCT lower(regexp_replace(source, '[0-9]', '', 'g')) || n_chars % 50 AS slug, 'old' AS content, n_chars % 50 % 4 = 0 AS hand FROM documents WHERE doc_id % 2 = 0),
n AS (SELECT DISTINCT lower(regexp_replace(source, '[0-9]', '', 'g')) || n_chars % 60 AS slug, 'new' AS content FROM documents WHERE doc_id % 2 = 1)
SELECT coalesce(o.slug, n.slug) AS slug, CASE WHEN o.slug IS NOT NULL AND (n.slug IS NULL OR o.hand) THEN o.content ELSE n.content END AS content,
 CASE WHEN o.slug IS NULL THEN 'insert' WHEN n.slug IS NULL OR o.hand THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.slug = n.slug""",
)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or update by slug; rows kept by hand stay as they are."""
    docs = table(spark, sf_dir, "documents")
    slug = lambda m: F.concat(F.lower(F.regexp_replace("source", "[0-9]", "")), (F.col("n_chars") % m).cast("string")).alias("slug")
    old = docs.where("doc_id % 2 = 0").select(slug(50), F.lit("old").alias("content"), (F.col("n_chars") % 50 % 4 == 0).alias("hand")).distinct()
    new = docs.where("doc_id % 2 = 1").select(slug(60), F.lit("new").alias("content")).distinct()
    return latest.upsert(old, new, "slug", ["content"], F.col("o.hand"))


@query(
    "versions",
    f"""WITH {EVENTS_SQL} SELECT run_id, id, row_number() OVER w AS version, lead(second) OVER w AS superseded_at, lead(second) OVER w IS NULL AS current FROM log WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY run_id ORDER BY second, id)""",
)
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of a record with the time at which the next one closed it."""
    hour, order = F.floor(F.col("second") / 3600), ["second", "id"]
    rows = events(spark, sf_dir).where("event_type = 'purchase'").select("run_id", "id", "second")
    rows = latest.running(rows, ["run_id"], hour, order, version=F.lit(1))
    rows = latest.by_buckets(rows, ["run_id"], hour, [F.min("second").alias("opens")], lambda w: [F.lead("opens").over(w).alias("later")])
    closed = F.coalesce(F.lead("second").over(Window.partitionBy("run_id", "_bucket").orderBy(*order)), "later")
    return rows.select("run_id", "id", F.col("version").cast("long").alias("version"), closed.alias("superseded_at"), closed.isNull().alias("current"))


@query(
    "orphaned_slugs",
    "SELECT DISTINCT source || lang AS slug FROM documents WHERE doc_id % 3 = 0 AND source || lang NOT IN (SELECT source || lang FROM documents WHERE doc_id % 3 = 1)",
)
def orphaned_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("slug", F.concat("source", "lang"))
    return docs.where("doc_id % 3 = 0").select("slug").distinct().join(docs.where("doc_id % 3 = 1").select("slug"), "slug", "left_anti")


@query(
    "retention",
    f"""WITH {EVENTS_SQL}, ended AS (SELECT run_id, max(second) AS ended FROM log WHERE state IN ('done', 'failed', 'cancelled') GROUP BY run_id),
cut AS (SELECT max(second) - 30 * 60 AS t FROM log)
SELECT count(*) AS kept, CAST(sum(second) % 1000003 AS BIGINT) AS mark FROM log WHERE NOT (run_id IN (SELECT run_id FROM ended, cut WHERE ended.ended < t)) AND NOT (state = 'done' AND second < (SELECT t - 86400 FROM cut))""",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after purging events of runs that ended long ago and old finished jobs."""
    log = events(spark, sf_dir)
    cut = log.agg((F.max("second") - 1800).alias("t"))
    ended = log.where(F.col("state").isin("done", "failed", "cancelled")).groupBy("run_id").agg(F.max("second").alias("at"))
    old = ended.join(F.broadcast(cut), F.col("at") < F.col("t"), "left_semi")  # cut is one row
    kept = log.join(old, "run_id", "left_anti").join(F.broadcast(cut), F.lit(True))
    kept = kept.where(~((F.col("state") == "done") & (F.col("second") < F.col("t") - 86400)))
    return kept.agg(F.count("*").alias("kept"), (F.sum("second") % 1000003).alias("mark"))


@query(
    "comment_dedup",
    """WITH h AS (SELECT conv_id, turn, sha256(conv_id || chr(1) || length(coalesce(nullif(trim(role), ''), '[deleted]')) || chr(1) || coalesce(nullif(trim(role), ''), '[deleted]') || chr(1) || text) AS body_hash FROM conversations)
SELECT body_hash, min(turn) AS turn, count(*) - 1 AS skipped FROM h GROUP BY body_hash""",
)
def comment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments by a length-guarded hash of conversation, author and body; repeats are skipped."""
    author = F.coalesce(F.nullif(F.btrim("role"), F.lit("")), F.lit("[deleted]"))
    key = F.concat_ws("\x01", F.col("conv_id").cast("string"), F.length(author).cast("string"), author, F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("turn", F.sha2(key, 256).alias("body_hash"))
    return rows.groupBy("body_hash").agg(F.min("turn").alias("turn"), (F.count("*") - 1).alias("skipped"))


@query("keyset_page", f"WITH {EVENTS_SQL} SELECT id, run_id, state FROM log WHERE run_id = 7 AND id > 500 ORDER BY id LIMIT 200")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("run_id = 7 AND id > 500").select("id", "run_id", "state").orderBy("id").limit(200)


@query("chunks", "SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 25 AS chunk, source FROM documents")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = latest.running(docs, ["source"], F.shiftright("doc_id", 12), ["doc_id"], n=F.lit(1))
    return rows.select("doc_id", F.floor((F.col("n") - 1) / 25).cast("long").alias("chunk"), "source")


@query(
    "reuse_analysis",
    "WITH c AS (SELECT md5(text) AS k, min(doc_id) AS first FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT d.doc_id, c.first AS reused FROM documents d LEFT JOIN c ON md5(d.text) = c.k WHERE d.doc_id % 2 = 1",
)
def reuse_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-cache lookup: the earlier document whose analysis fits an equal text."""
    docs = table(spark, sf_dir, "documents").withColumn("k", F.md5("text"))
    cache = docs.where("doc_id % 2 = 0").groupBy("k").agg(F.min("doc_id").alias("reused"))
    return docs.where("doc_id % 2 = 1").join(cache, "k", "left").select("doc_id", "reused")


@query(
    "id_set_check",
    "SELECT count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS extra FROM (SELECT d.doc_id AS a, l.doc_id AS b FROM documents d FULL JOIN (SELECT doc_id FROM labels WHERE doc_id % 3 > 0) l ON d.doc_id = l.doc_id)",
)
def id_set_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"))
    got = table(spark, sf_dir, "labels").where("doc_id % 3 > 0").select(F.col("doc_id").alias("b"))
    both = want.join(got, F.col("a") == F.col("b"), "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))
