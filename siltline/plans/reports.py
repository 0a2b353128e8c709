"""Reports over leads and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import like_escaped
from ..operators import latest
from ..sources.tables import EVENTS_SQL, LEADS_SQL, NOW, events, leads, table
from .registry import query

_ratio = lambda a, b: f"CAST(round({a} / nullif({b}, 0)::DOUBLE, 4) AS DOUBLE)"


@query("status_counts", f"WITH {LEADS_SQL} SELECT CASE WHEN coalesce(status, '') = '' THEN 'new' ELSE status END AS state, count(*) AS n FROM leads GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM leads")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.coalesce(F.nullif("status", F.lit("")), F.lit("new"))
    rolled = leads(spark, sf_dir).withColumn("state", state).rollup("state").agg(F.count("*").alias("n"))
    return rolled.select(F.coalesce("state", F.lit("total")).alias("state"), "n")


@query(
    "keyword_breakdown",
    f"""WITH {LEADS_SQL}, w AS (SELECT id, unnest(list_distinct(list_filter(string_split(lower(title), ' '), lambda x: length(x) > 3))) AS word FROM leads)
SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 20""",
)
def keyword_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that most titles hold; a title counts each token once."""
    words = F.array_distinct(F.filter(F.split(F.lower("title"), " "), lambda x: F.length(x) > 3))
    counts = leads(spark, sf_dir).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(20)


@query("subreddit_breakdown", f"WITH {LEADS_SQL} SELECT subreddit, count(*) AS n, CAST(round(avg(score), 2) AS DOUBLE) AS mean FROM leads GROUP BY 1 ORDER BY n DESC, subreddit LIMIT 20")
def subreddit_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = leads(spark, sf_dir).groupBy("subreddit").agg(F.count("*").alias("n"), F.round(F.avg("score"), 2).alias("mean"))
    return groups.orderBy(F.desc("n"), "subreddit").limit(20)


@query("leads_by_day", f"WITH {LEADS_SQL} SELECT CAST(CAST(TIMESTAMP '{NOW}' - to_hours(age_hours) AS DATE) AS VARCHAR) AS day, count(*) AS n FROM leads GROUP BY 1 ORDER BY day LIMIT 30")
def leads_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads a day, of the oldest thirty days as the dashboard's limit has it."""
    day = F.to_date(F.timestamp_seconds(F.unix_timestamp(F.lit(NOW)) - F.col("age_hours") * 3600)).cast("string")
    return leads(spark, sf_dir).groupBy(day.alias("day")).agg(F.count("*").alias("n")).orderBy("day").limit(30)


@query("scalar_stats", f"WITH {LEADS_SQL} SELECT count(*) AS leads, CAST(round(avg(score), 4) AS DOUBLE) AS mean, count(*) FILTER (status = 'contacted') AS contacted, count(*) FILTER (status = 'ignored') AS ignored, count(DISTINCT subreddit) AS subs, min(age_hours) AS newest, max(age_hours) AS oldest, count(*) FILTER (body = '') AS absent FROM leads")
def scalar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dashboard figures in one pass."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return leads(spark, sf_dir).agg(
        F.count("*").alias("leads"), F.round(F.avg("score"), 4).alias("mean"), is_("contacted").alias("contacted"), is_("ignored").alias("ignored"),
        F.countDistinct("subreddit").alias("subs"), F.min("age_hours").alias("newest"), F.max("age_hours").alias("oldest"), F.count_if(F.col("body") == "").alias("absent"),
    )


@query("paged_search", f"WITH {LEADS_SQL} SELECT id, score, title FROM leads WHERE score >= 20 AND title ILIKE '%the%' ORDER BY score DESC, id DESC LIMIT 50 OFFSET 50")
def paged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leads(spark, sf_dir).where((F.col("score") >= 20) & F.col("title").ilike(f"%{like_escaped('the')}%"))
    return latest.page(found.select("id", "score", "title"), 2, 50, F.desc("score"), F.desc("id"))


@query("search_total", f"WITH {LEADS_SQL} SELECT count(*) AS n, count(*) FILTER (title LIKE '%*%' OR body LIKE '%*%') AS starred FROM leads WHERE title ILIKE '%100\\%%' ESCAPE '\\' OR body ILIKE '%\\%%' ESCAPE '\\'")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a term that holds a wildcard, taken literally."""
    df = leads(spark, sf_dir)
    df = df.where(F.col("title").ilike(f"%{like_escaped('100%')}%") | F.col("body").ilike(f"%{like_escaped('%')}%"))
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("title").contains("*") | F.col("body").contains("*")).alias("starred"))


@query("comment_counts", "SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY conv_id")
def comment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("users"))


STATES = ("queued", "running", "done", "failed", "cancelled")


@query("job_counts", f"WITH {EVENTS_SQL} SELECT run_id, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in STATES) + " FROM log GROUP BY run_id")
def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("run_id").pivot("state", list(STATES)).count().na.fill(0)


@query("queue_depth", f"WITH {EVENTS_SQL} SELECT count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'running') AS running, min(second) FILTER (state = 'queued') AS next_at FROM log")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = F.col("state") == "queued"
    return events(spark, sf_dir).agg(F.count_if(queued).alias("queued"), F.count_if(F.col("state") == "running").alias("running"), F.min(F.when(queued, F.col("second"))).alias("next_at"))


@query(
    "usage",
    f"""WITH {EVENTS_SQL} SELECT run_id, count(*) AS calls, CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(uncached) AS BIGINT) AS uncached, CAST(sum(out_tokens) AS BIGINT) AS out_tokens, CAST(round(avg(latency_ms), 4) AS DOUBLE) AS latency,
 {_ratio("sum(cached)", "sum(cached) + sum(uncached)")} AS cache_ratio, count(DISTINCT prefix) AS prefixes FROM log GROUP BY run_id""",
)
def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("run_id").agg(
        F.count("*").alias("calls"), F.sum("cached").alias("cached"), F.sum("uncached").alias("uncached"), F.sum("out_tokens").alias("out_tokens"),
        F.round(F.avg("latency_ms"), 4).alias("latency"), F.round(F.try_divide(F.sum("cached"), F.sum("cached") + F.sum("uncached")), 4).alias("cache_ratio"),
        F.countDistinct("prefix").alias("prefixes"),
    )


@query("usage_by_day", f"WITH {EVENTS_SQL} SELECT second // 86400 AS day, strftime(make_timestamp(second * 1000000), '%Y-%m') AS month, event_type AS outcome, count(*) AS n FROM log GROUP BY ALL")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    month = F.date_format(F.timestamp_seconds("second"), "yyyy-MM")
    return log.groupBy(F.floor(F.col("second") / 86400).alias("day"), month.alias("month"), F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "latency_quantiles",
    f"""WITH {EVENTS_SQL}, g AS (SELECT run_id, list_sort(list(latency_ms)) AS l FROM log GROUP BY run_id)
SELECT run_id, l[1 + least(len(l) - 1, CAST(floor(len(l) * 0.5) AS BIGINT))] AS p50, l[1 + least(len(l) - 1, CAST(floor(len(l) * 0.95) AS BIGINT))] AS p95 FROM g""",
)
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles from counts by value, so no task gathers a run's calls."""
    counts = events(spark, sf_dir).groupBy("run_id", "latency_ms").agg(F.count("*").alias("c"))
    run = Window.partitionBy("run_id")
    rows = counts.withColumn("n", F.sum("c").over(run)).withColumn("upto", F.sum("c").over(run.orderBy("latency_ms")))
    at = lambda share: F.least(F.col("n") - 1, F.floor(F.col("n") * share))
    quantile = lambda share: F.min(F.when(F.col("upto") > at(share), F.col("latency_ms")))
    return rows.groupBy("run_id").agg(quantile(0.5).alias("p50"), quantile(0.95).alias("p95"))


#: Tenths of a micro-dollar for a token: cached input, other input, output.
PRICES = (1, 10, 40)


@query("spend", f"WITH {EVENTS_SQL} SELECT run_id, second // 86400 AS day, CAST(sum(cached * {PRICES[0]} + uncached * {PRICES[1]} + out_tokens * {PRICES[2]}) AS BIGINT) / 10000000::DOUBLE AS cost FROM log GROUP BY ALL")
def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollars by run and day; summed as whole units, so the order of rows does not matter."""
    units = F.col("cached") * PRICES[0] + F.col("uncached") * PRICES[1] + F.col("out_tokens") * PRICES[2]
    day = F.floor(F.col("second") / 86400)
    return events(spark, sf_dir).groupBy("run_id", day.alias("day")).agg((F.sum(units) / 10000000.0).alias("cost"))


@query(
    "budget_breach",
    f"""WITH {EVENTS_SQL}, s AS (SELECT run_id, id, count(*) OVER w AS calls, sum(cached + uncached * 10 + out_tokens * 40) OVER w AS spent FROM log WINDOW w AS (PARTITION BY run_id ORDER BY second, id ROWS UNBOUNDED PRECEDING))
SELECT run_id, min(calls) AS call, CASE WHEN min(calls) FILTER (spent > 1000000) <= 150 THEN 'spend' ELSE 'calls' END AS ceiling FROM s WHERE calls > 150 OR spent > 1000000 GROUP BY run_id""",
)
def budget_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first call of each run that goes over the ceiling of calls or of spend."""
    units = F.expr("cached + uncached * 10 + out_tokens * 40")
    log = events(spark, sf_dir).select("run_id", "id", "second", units.alias("units"))
    rows = latest.running(log, ["run_id"], F.floor(F.col("second") / 3600), ["second", "id"], calls=F.lit(1), spent=F.col("units"))
    over = rows.where("calls > 150 OR spent > 1000000").groupBy("run_id")
    by_spend = F.min(F.when(F.col("spent") > 1000000, F.col("calls"))) <= 150
    return over.agg(F.min("calls").alias("call"), F.when(by_spend, "spend").otherwise("calls").alias("ceiling"))


@query(
    "outcome_summary",
    f"""WITH {EVENTS_SQL} SELECT channel % 10 AS pool, count(*) AS n, {_ratio("count(*) FILTER (event_type <> 'error')", "count(*)")} AS success, {_ratio("count(*) FILTER (event_type = 'error')", "count(*)")} AS blocked,
 count(*) >= 10 AND count(*) FILTER (event_type <> 'error') < 0.2 * count(*) AS collapsed FROM log GROUP BY 1""",
)
def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, n = F.count_if(F.col("event_type") != "error"), F.count("*")
    return events(spark, sf_dir).groupBy((F.col("channel") % 10).alias("pool")).agg(
        n.alias("n"), F.round(ok / n, 4).alias("success"), F.round((n - ok) / n, 4).alias("blocked"), ((n >= 10) & (ok < 0.2 * n)).alias("collapsed")
    )


@query(
    "event_evidence",
    f"""WITH {EVENTS_SQL} SELECT run_id, max(second) FILTER (event_type = 'purchase') AS last_purchase, count(*) FILTER (event_type = 'error') AS errors,
 array_to_string(list_sort(list(DISTINCT channel) FILTER (event_type = 'signup')), ',') AS channels, arg_max(state, (second, id)) AS last_state FROM log GROUP BY run_id""",
)
def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: the last of a kind, a count, a list of channels and the newest state."""
    kind = lambda k: F.col("event_type") == k
    chans = F.transform(F.array_sort(F.collect_set(F.when(kind("signup"), F.col("channel")))), lambda x: x.cast("string"))
    return events(spark, sf_dir).groupBy("run_id").agg(
        F.max(F.when(kind("purchase"), F.col("second"))).alias("last_purchase"), F.count_if(kind("error")).alias("errors"),
        F.array_join(chans, ",").alias("channels"), F.max_by("state", F.struct("second", "id")).alias("last_state"),
    )


@query("csv_export", f"WITH {LEADS_SQL} SELECT id, subreddit, coalesce(author, '') AS author, title, CAST(coalesce(score, 0) AS BIGINT) AS score FROM leads WHERE status = 'contacted'")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).where("status = 'contacted'")
    return rows.select("id", "subreddit", F.coalesce("author", F.lit("")).alias("author"), "title", F.coalesce("score", F.lit(0)).cast("long").alias("score"))


@query("session_windows", None)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with a gap of thirty minutes; an extension."""
    s = F.session_window("ts", "30 minutes")
    return table(spark, sf_dir, "events").groupBy("user_id", s.alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")
