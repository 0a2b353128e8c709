"""The run desk: pools, metrics, queues, cursors and upkeep over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redact
from ..sources.tables import EVENTS_SQL, events, table
from .registry import query
from .scoring import FUNNEL_SQL, _redact_sql, stages

_ratio = lambda a, b: f"CAST(round({a} / nullif({b}, 0)::DOUBLE, 4) AS DOUBLE)"
_OK = "event_type <> 'error'"


@query(
    "pool_snapshot",
    f"""WITH {EVENTS_SQL}, e AS (SELECT channel, count(*) AS n, count(*) FILTER ({_OK}) AS ok FROM log GROUP BY channel)
SELECT count(*) AS exits, count(*) FILTER (ok >= 0.5 * n) AS healthy, {_ratio("sum(ok)", "sum(n)")} AS acceptance, CAST(round(greatest(900 * count(*) FILTER (ok >= 0.5 * n) / count(*)::DOUBLE, 60), 4) AS DOUBLE) AS cooldown FROM e""",
)
def pool_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exits, healthy ones, the pool's acceptance and its cooldown, which shrinks with the pool to a floor."""
    e = events(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.count_if(F.expr(_OK)).alias("ok"))
    s = e.agg(F.count("*").alias("exits"), F.count_if(F.col("ok") >= 0.5 * F.col("n")).alias("healthy"), F.round(F.try_divide(F.sum("ok"), F.sum("n")), 4).alias("acceptance"))
    return s.withColumn("cooldown", F.round(F.greatest(F.try_divide(900 * F.col("healthy"), F.col("exits")), F.lit(60.0)), 4))


@query(
    "exit_selection",
    f"""WITH {EVENTS_SQL}, e AS (SELECT channel % 10 AS pool, channel, count(*) FILTER ({_OK}) / count(*)::DOUBLE AS rate, count(*) AS n, max(second) AS used FROM log GROUP BY ALL)
SELECT pool, channel FROM (SELECT pool, channel, row_number() OVER (PARTITION BY pool ORDER BY CASE WHEN n >= 5 THEN -round(rate, 6) ELSE 0 END, used, channel) AS r FROM e) WHERE r = 1""",
)
def exit_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pool the exit with the best acceptance, where that is measured, then the least recently used."""
    e = events(spark, sf_dir).groupBy((F.col("channel") % 10).alias("pool"), "channel").agg((F.count_if(F.expr(_OK)) / F.count("*")).alias("rate"), F.count("*").alias("n"), F.max("second").alias("used"))
    rank = F.struct(F.when(F.col("n") >= 5, -F.round("rate", 6)).otherwise(0.0), "used", "channel")
    return e.groupBy("pool").agg(F.min_by("channel", rank).alias("channel"))


@query(
    "metric_health",
    f"""WITH {EVENTS_SQL}, m AS (SELECT sum(cached) / sum(cached + uncached)::DOUBLE AS c, count(*) FILTER (event_type = 'click') / count(*)::DOUBLE AS r, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS e, count(DISTINCT prefix)::DOUBLE AS p, count(*) AS n FROM log)
SELECT 'prefix_cache_ratio' AS metric, CAST(round(c, 4) AS DOUBLE) AS value, 0.8::DOUBLE AS target, c >= 0.8 OR n < 2 AS ok FROM m UNION ALL SELECT 'repair_rate', CAST(round(r, 4) AS DOUBLE), 0.05, r <= 0.05 FROM m
UNION ALL SELECT 'empty_rate', CAST(round(e, 4) AS DOUBLE), 0.01, e <= 0.01 FROM m UNION ALL SELECT 'distinct_prefixes', p, 1, p <= 1 FROM m""",
)
def metric_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric with its target and whether it is met, from one pass."""
    share = lambda kind: F.count_if(F.col("event_type") == kind) / F.count("*")
    m = events(spark, sf_dir).agg((F.sum("cached") / F.sum(F.col("cached") + F.col("uncached"))).alias("c"), share("click").alias("r"), share("error").alias("e"), F.countDistinct("prefix").cast("double").alias("p"), F.count("*").alias("n"))
    row = lambda name, value, target, ok: F.struct(F.lit(name).alias("metric"), value.alias("value"), F.lit(target).alias("target"), ok.alias("ok"))
    return m.select(F.inline(F.array(
        row("prefix_cache_ratio", F.round("c", 4), 0.8, (F.col("c") >= 0.8) | (F.col("n") < 2)), row("repair_rate", F.round("r", 4), 0.05, F.col("r") <= 0.05),
        row("empty_rate", F.round("e", 4), 0.01, F.col("e") <= 0.01), row("distinct_prefixes", F.col("p"), 1.0, F.col("p") <= 1),
    )))


@query("section_duplicates", "SELECT source AS section, lower(lang) AS slug, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def section_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs that a section has more than once."""
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("section"), F.lower("lang").alias("slug"))
    return rows.agg(F.count("*").alias("n")).where("n > 1")


@query("recent_calls", f"WITH {EVENTS_SQL} SELECT id, second, state FROM log ORDER BY second DESC, id DESC LIMIT 25")
def recent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("id", "second", "state").orderBy(F.desc("second"), F.desc("id")).limit(25)


@query("active_jobs", f"WITH {EVENTS_SQL} SELECT run_id, max(id) AS id, arg_max(state, id) AS state FROM log WHERE state IN ('queued', 'running') GROUP BY run_id")
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each run that has not ended."""
    live = events(spark, sf_dir).where(F.col("state").isin("queued", "running"))
    return live.groupBy("run_id").agg(F.max("id").alias("id"), F.max_by("state", "id").alias("state"))


@query("next_claims", f"WITH {EVENTS_SQL} SELECT run_id, arg_min(id, (10 - channel % 3, id)) AS id FROM log WHERE state = 'queued' AND second <= (SELECT max(second) - 60 FROM log) GROUP BY run_id")
def next_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that each run's next worker would take: available, by priority and then age."""
    log = events(spark, sf_dir)
    now = log.agg((F.max("second") - 60).alias("now"))  # one row
    free = log.where("state = 'queued'").join(F.broadcast(now), F.col("second") <= F.col("now"), "left_semi")
    return free.groupBy("run_id").agg(F.min_by("id", F.struct(10 - F.col("channel") % 3, "id")).alias("id"))


@query(
    "queue_edits",
    f"""WITH {EVENTS_SQL} SELECT run_id, count(*) FILTER (state = 'queued' AND run_id % 4 = 0) AS cancelled, count(*) FILTER (state = 'failed' AND run_id % 4 = 1) AS requeued,
 CAST(sum(CASE WHEN state = 'failed' AND run_id % 4 = 1 THEN CASE WHEN id % 4 >= 3 THEN id % 4 + 1 ELSE 3 END ELSE 3 END) AS BIGINT) AS attempts FROM log GROUP BY run_id""",
)
def queue_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an operator's cancelling (runs 0, 4, ...) and retrying (runs 1, 5, ...) changes; a spent job gets one more attempt."""
    again = (F.col("state") == "failed") & (F.col("run_id") % 4 == 1)
    spent = F.col("id") % 4
    return events(spark, sf_dir).groupBy("run_id").agg(
        F.count_if((F.col("state") == "queued") & (F.col("run_id") % 4 == 0)).alias("cancelled"), F.count_if(again).alias("requeued"),
        F.sum(F.when(again, F.when(spent >= 3, spent + 1).otherwise(3)).otherwise(3)).alias("attempts"),
    )


@query("degradation_notices", f"WITH {EVENTS_SQL} SELECT run_id, state, arg_min(id, (second, id)) AS id, count(*) - 1 AS repeats FROM log WHERE event_type = 'error' GROUP BY ALL")
def degradation_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failure of each run and state; further ones are repeats and give no notice."""
    return first_failures(events(spark, sf_dir).where("event_type = 'error'"))


def first_failures(bad: DataFrame) -> DataFrame:
    """(run_id, state, id, repeats) of failures with run_id, state, second and id."""
    return bad.groupBy("run_id", "state").agg(F.min_by("id", F.struct("second", "id")).alias("id"), (F.count("*") - 1).alias("repeats"))


@query("metric_retention", f"WITH {EVENTS_SQL}, m AS (SELECT max(second) AS now FROM log) SELECT second // 86400 AS day, count(*) AS n FROM log, m WHERE second >= now - 14 * 86400 GROUP BY 1")
def metric_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the last fourteen days, by day."""
    log = events(spark, sf_dir)
    now = log.agg(F.max("second").alias("now"))  # one row
    kept = log.join(F.broadcast(now), F.col("second") >= F.col("now") - 14 * 86400, "left_semi")
    return kept.groupBy(F.floor(F.col("second") / 86400).alias("day")).agg(F.count("*").alias("n"))


@query(
    "event_records",
    f"""WITH r AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'info' ELSE 'warning' END AS level, {_redact_sql("'token=' || event_type || 'secret' || user_id || ' by user'")} AS message FROM events)
SELECT event_id, level, '{{"level":"' || level || '","message":"' || message || '"}}' AS data FROM r""",
)
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records as JSON with secrets taken out of their message."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "error").when(kind == "view", "info").otherwise("warning")
    message = redact(F.concat(F.lit("token="), kind, F.lit("secret"), F.col("user_id").cast("string"), F.lit(" by user")))
    rows = table(spark, sf_dir, "events").select("event_id", level.alias("level"), message.alias("message"))
    return rows.select("event_id", "level", F.to_json(F.struct("level", "message")).alias("data"))


@query(
    "cursor_upsert",
    f"""WITH {EVENTS_SQL}, o AS (SELECT channel, nullif(id % 3, 0) AS ask, max(second) AS seen FROM log WHERE id % 2 = 0 GROUP BY ALL), n AS (SELECT channel, nullif(id % 4, 0) AS ask, max(second) AS seen FROM log WHERE id % 2 = 1 GROUP BY ALL)
SELECT coalesce(o.channel, n.channel) AS channel, coalesce(o.ask, n.ask) AS ask, coalesce(n.seen, o.seen) AS seen FROM o FULL JOIN n ON o.channel = n.channel AND o.ask IS NOT DISTINCT FROM n.ask""",
)
def cursor_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored cursors with newer ones written over them; a cursor without a search term has a null key."""
    log = events(spark, sf_dir)
    side = lambda odd, m: log.where(F.col("id") % 2 == odd).groupBy("channel", F.nullif(F.col("id") % m, F.lit(0)).alias("ask")).agg(F.max("second").alias("seen"))
    old, new = side(0, 3).alias("o"), side(1, 4).alias("n")
    both = old.join(new, (F.col("o.channel") == F.col("n.channel")) & F.col("o.ask").eqNullSafe(F.col("n.ask")), "full_outer")
    return both.select(*(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("channel", "ask")), F.coalesce("n.seen", "o.seen").alias("seen"))


@query("funnel_check", FUNNEL_SQL + "SELECT stage, count(*) = count(reason) + count(*) FILTER (reason IS NULL) AS sums, CAST(round(count(reason) / count(*)::DOUBLE, 4) AS DOUBLE) AS saved FROM stages GROUP BY stage")
def funnel_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether admitted and rejected add up to collected, and the share that a stage saves."""
    return stages(spark, sf_dir).groupBy("stage").agg((F.count("*") == F.count("reason") + F.count_if(F.col("reason").isNull())).alias("sums"), F.round(F.try_divide(F.count("reason"), F.count("*")), 4).alias("saved"))


@query(
    "transport_advice",
    f"""WITH {EVENTS_SQL}, t AS (SELECT run_id, count(*) FILTER ({_OK} AND channel % 2 = 0) / nullif(count(*) FILTER (channel % 2 = 0), 0)::DOUBLE AS a, count(*) FILTER ({_OK} AND channel % 2 = 1) / nullif(count(*) FILTER (channel % 2 = 1), 0)::DOUBLE AS b FROM log GROUP BY run_id)
SELECT run_id, CASE WHEN b IS NULL OR a IS NULL THEN 'unmeasured' WHEN round(b - a, 9) >= 0.1 THEN 'proxy' ELSE 'direct' END AS advice FROM t""",
)
def transport_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the proxy only where its success rate is ten points better than without."""
    rate = lambda odd: F.try_divide(F.count_if(F.expr(_OK) & (F.col("channel") % 2 == odd)), F.count_if(F.col("channel") % 2 == odd))
    t = events(spark, sf_dir).groupBy("run_id").agg(rate(0).alias("a"), rate(1).alias("b"))
    advice = F.when(F.col("a").isNull() | F.col("b").isNull(), "unmeasured").when(F.round(F.col("b") - F.col("a"), 9) >= 0.1, "proxy").otherwise("direct")
    return t.select("run_id", advice.alias("advice"))


@query(
    "exit_lines",
    r"""WITH r AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '# ' || s_name WHEN 1 THEN 'h' || s_suppkey || ':' || (8000 + s_suppkey) WHEN 2 THEN ' h' || s_suppkey || '.x:80:u' || s_suppkey || ':p:w ' WHEN 3 THEN 'h:99999' ELSE 'h' END AS line FROM supplier),
p AS (SELECT s_suppkey, trim(line) AS line, regexp_extract(trim(line), '^([^:\s]+):([0-9]+)(:([^:\s]+):(\S+))?$', ['host', 'port', 'rest', 'name', 'secret']) AS m FROM r)
SELECT s_suppkey, CASE WHEN line = '' OR starts_with(line, '#') THEN 'skipped' WHEN m.host = '' OR try_cast(m.port AS BIGINT) NOT BETWEEN 1 AND 65535 THEN 'malformed' ELSE m.host || ':' || m.port || CASE WHEN m.name <> '' THEN ' as ' || m.name ELSE '' END END AS exit FROM p""",
)
def exit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines host:port or host:port:user:password; a malformed line is never repeated in the message."""
    n = F.col("s_suppkey").cast("string")
    h = F.concat(F.lit("h"), n)
    line = (
        F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("# "), "s_name")).when(F.col("s_suppkey") % 5 == 1, F.concat(h, F.lit(":"), (8000 + F.col("s_suppkey")).cast("string")))
        .when(F.col("s_suppkey") % 5 == 2, F.concat(F.lit(" "), h, F.lit(".x:80:u"), n, F.lit(":p:w "))).when(F.col("s_suppkey") % 5 == 3, "h:99999").otherwise("h")
    )
    t = F.btrim(line)
    part = lambda i: F.regexp_extract(t, r"^([^:\s]+):([0-9]+)(:([^:\s]+):(\S+))?$", i)
    named = F.when(part(4) != "", F.concat(F.lit(" as "), part(4))).otherwise("")
    shown = F.when(part(2).try_cast("int").between(1, 65535), F.concat(part(1), F.lit(":"), part(2), named)).otherwise("malformed")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when((t == "") | t.startswith("#"), "skipped").otherwise(shown).alias("exit"))


@query("recent_runs", f"WITH {EVENTS_SQL} SELECT run_id, max(second) AS last FROM log GROUP BY run_id ORDER BY run_id DESC LIMIT 10")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("run_id").agg(F.max("second").alias("last")).orderBy(F.desc("run_id")).limit(10)


@query(
    "breaker_admits",
    f"""WITH {EVENTS_SQL}, b AS (SELECT channel, max(second) FILTER (event_type = 'error') AS failed_at, count(*) FILTER (event_type = 'error') >= 3 AS tripped, max(second) AS now FROM log GROUP BY channel)
SELECT channel, CASE WHEN NOT tripped THEN 'closed' WHEN now - failed_at >= 3600 THEN 'half_open' ELSE 'open' END AS state FROM b""",
)
def breaker_admits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a breaker that opened lets a try through: an hour after the last failure it does."""
    bad = F.col("event_type") == "error"
    b = events(spark, sf_dir).groupBy("channel").agg(F.max(F.when(bad, F.col("second"))).alias("failed_at"), (F.count_if(bad) >= 3).alias("tripped"), F.max("second").alias("now"))
    return b.select("channel", F.when(~F.col("tripped"), "closed").when(F.col("now") - F.col("failed_at") >= 3600, "half_open").otherwise("open").alias("state"))


