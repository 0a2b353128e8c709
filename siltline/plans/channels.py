"""Polling cursors, health folds and failure streaks over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import latest
from ..sources.tables import EVENTS_SQL, events
from .registry import query

#: A poll is an hour of a channel's log; a post is new unless it is an error event.
POLLS_SQL = f"""{EVENTS_SQL}, polls AS (SELECT channel, second // 3600 AS poll, count(*) FILTER (event_type <> 'error') AS fresh, min(second) AS oldest, max(second) AS newest FROM log GROUP BY ALL)"""


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("channel", F.floor(F.col("second") / 3600).alias("poll")).agg(
        F.count_if(F.col("event_type") != "error").alias("fresh"), F.min("second").alias("oldest"), F.max("second").alias("newest")
    )


@query(
    "cursor_advance",
    f"""WITH {POLLS_SQL}, o AS (SELECT channel, list(struct_pack(p := poll, n := fresh, t := newest) ORDER BY poll) AS ps FROM polls GROUP BY channel),
f AS (SELECT channel, ps, list_transform(ps, lambda p, i: CASE WHEN i = 1 THEN CAST(NULL AS DOUBLE) ELSE p.n / (p.p - ps[i - 1].p)::DOUBLE END) AS rates FROM o)
SELECT channel, list_max(list_transform(ps, lambda p: p.t)) AS last_seen, len(ps) AS n_polls,
 CAST(round(list_reduce(list_filter(rates, lambda r: r IS NOT NULL), lambda a, r: 0.3 * r + 0.7 * a), 6) AS DOUBLE) AS rate FROM f WHERE len(ps) > 1""",
)
def cursor_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursor of each channel after all its polls: newest time seen and smoothed rate an hour."""
    ordered = F.array_sort(F.collect_list(F.struct("poll", "fresh", "newest")))
    per = polls(spark, sf_dir).groupBy("channel").agg(ordered.alias("ps")).where(F.size("ps") > 1)
    start = F.struct(F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("rate"))

    def advance(state, p):
        observed = p.fresh / (p.poll - state["at"])
        rate = F.when(state["at"].isNull(), state["rate"]).when(state["rate"].isNull(), observed).otherwise(0.3 * observed + 0.7 * state["rate"])
        return F.struct(p.poll.alias("at"), rate.cast("double").alias("rate"))

    rate = F.aggregate("ps", start, advance, lambda s: s["rate"])
    return per.select("channel", F.array_max(F.transform("ps", lambda p: p.newest)).alias("last_seen"), F.size("ps").cast("long").alias("n_polls"), F.round(rate, 6).alias("rate"))


@query("overflow", f"WITH {POLLS_SQL} SELECT channel, poll, oldest > lag(newest) OVER (PARTITION BY channel ORDER BY poll) AS overflow FROM polls")
def overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a poll's oldest post is newer than all seen before; unknown on a cold start."""
    before = F.lag("newest").over(Window.partitionBy("channel").orderBy("poll"))
    return polls(spark, sf_dir).select("channel", "poll", (F.col("oldest") > before).alias("overflow"))


@query(
    "next_interval",
    f"""WITH {POLLS_SQL}, r AS (SELECT channel, sum(fresh) / count(*)::DOUBLE AS rate, count(*) FILTER (fresh = 0) AS empty, channel % 3 / 10.0::DOUBLE AS yield FROM polls GROUP BY channel)
SELECT channel, CAST(round(CASE WHEN rate <= 0 THEN 86400 ELSE least(greatest(60 / rate * 3600 * (1 + 0.5 * least(empty, 6)) / (1 + yield), 900), 86400) END, 4) AS DOUBLE) AS seconds FROM r""",
)
def next_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to the next poll: target over rate, slowed by empty polls, sped up by yield, clamped."""
    r = polls(spark, sf_dir).groupBy("channel").agg((F.sum("fresh") / F.count("*")).alias("rate"), F.count_if(F.col("fresh") == 0).alias("empty"))
    seconds = 60 / F.col("rate") * 3600 * (1 + 0.5 * F.least("empty", F.lit(6))) / (1 + F.col("channel") % 3 / 10.0)
    clamped = F.least(F.greatest(seconds, F.lit(900.0)), F.lit(86400.0))
    return r.select("channel", F.round(F.when(F.col("rate") <= 0, 86400.0).otherwise(clamped), 4).alias("seconds"))


@query("due_channels", f"WITH {POLLS_SQL}, d AS (SELECT channel, CASE WHEN channel % 10 = 0 THEN NULL ELSE max(newest) + 3600 END AS next_at FROM polls GROUP BY channel) SELECT channel, next_at FROM d WHERE next_at IS NULL OR next_at <= (SELECT max(second) FROM log) ORDER BY next_at NULLS FIRST, channel LIMIT 50")
def due_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = polls(spark, sf_dir)
    next_at = F.when(F.col("channel") % 10 != 0, F.col("newest") + 3600)
    d = p.groupBy("channel").agg(F.max("newest").alias("newest")).select("channel", next_at.alias("next_at"))
    now = p.agg(F.max("newest").alias("now"))  # one row
    due = d.join(F.broadcast(now), F.lit(True)).where("next_at IS NULL OR next_at <= now")
    return due.orderBy(F.asc_nulls_first("next_at"), "channel").limit(50).select("channel", "next_at")


@query("known_diff", f"WITH {EVENTS_SQL} SELECT id, channel FROM log WHERE event_type = 'view' AND channel NOT IN (SELECT channel FROM log WHERE event_type = 'purchase' AND run_id < 5)")
def known_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    known = log.where("event_type = 'purchase' AND run_id < 5").select("channel").distinct()
    return log.where("event_type = 'view'").select("id", "channel").join(known, "channel", "left_anti")


@query(
    "failure_streaks",
    f"""WITH {EVENTS_SQL}, s AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY second, id) AS island FROM log),
g AS (SELECT channel, island, count(*) FILTER (event_type = 'error') AS run FROM s GROUP BY ALL)
SELECT channel, max(run) AS longest, max(run) >= 3 AS blacklisted, CAST(sum(run) AS BIGINT) AS failures FROM g GROUP BY channel""",
)
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of consecutive failures of an exit; three in a row blacklist it."""
    log = events(spark, sf_dir).select("channel", "id", "second", (F.col("event_type") == "error").alias("bad"))
    log = latest.running(log, ["channel"], F.floor(F.col("second") / 3600), ["second", "id"], island=F.when(F.col("bad"), 0).otherwise(1))
    runs = log.groupBy("channel", "island").agg(F.count_if("bad").alias("run"))
    return runs.groupBy("channel").agg(F.max("run").alias("longest"), (F.max("run") >= 3).alias("blacklisted"), F.sum("run").alias("failures"))


@query(
    "breaker_fold",
    f"""WITH {EVENTS_SQL}, o AS (SELECT run_id, list(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END ORDER BY second, id) AS e FROM log GROUP BY run_id)
SELECT run_id, list_reduce(e, lambda a, x: CASE WHEN x = 0 THEN a // 1000 * 1000 WHEN a % 1000 + 1 >= 3 THEN (a // 1000 + 1) * 1000 ELSE a + 1 END, 0) // 1000 AS opened FROM o""",
)
def breaker_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a breaker that opens at three consecutive failures opened in each run.

    A run's hours are summed up first (failures at either end, openings between them), so no task
    orders a whole run's events; the fold over a run's hours carries the failures at the end.
    """
    order = F.array_sort(F.collect_list(F.struct("second", "id", F.when(F.col("event_type") == "error", "1").otherwise("0").alias("bad"))))
    hours = events(spark, sf_dir).groupBy("run_id", F.floor(F.col("second") / 3600).alias("hour")).agg(order.alias("xs"))
    hours = hours.select("run_id", "hour", F.array_join(F.transform("xs", lambda x: x.bad), "").alias("e"))
    head, tail = F.length(F.regexp_extract("e", "^1*", 0)), F.length(F.regexp_extract("e", "1*$", 0))
    inner = F.size(F.regexp_extract_all(F.substring(F.col("e"), head + 1, F.length("e") - head - tail), F.lit("111"), 0))
    hour = F.struct("hour", (head == F.length("e")).alias("all"), head.alias("head"), tail.alias("tail"), F.greatest(inner, F.lit(0)).alias("inner"))
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.lit(0).cast("long").alias("opened"))

    def fold(s, x):
        carry = F.when(x["all"], s["carry"] + x.head).otherwise(x.tail).cast("long")
        more = F.when(x["all"], 0).otherwise(F.floor((s["carry"] + x.head) / 3) + x.inner).cast("long")
        return F.struct(carry.alias("carry"), (s["opened"] + more).alias("opened"))

    ended = F.aggregate(F.array_sort(F.collect_list(hour)), start, fold, lambda s: s["opened"] + F.floor(s["carry"] / 3))
    return hours.groupBy("run_id").agg(ended.alias("opened"))


@query(
    "reclaim_expired",
    f"""WITH {EVENTS_SQL}, m AS (SELECT max(second) AS now FROM log) SELECT id, CASE WHEN state <> 'running' OR second + 900 >= now THEN state WHEN id % 4 < 3 THEN 'queued' ELSE 'failed' END AS state FROM log, m""",
)
def reclaim_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs whose lease is over go back to the queue while attempts are left."""
    log = events(spark, sf_dir)
    now = log.agg(F.max("second").alias("now"))  # one row
    held = (F.col("state") != "running") | (F.col("second") + 900 >= F.col("now"))
    state = F.when(held, F.col("state")).when(F.col("id") % 4 < 3, "queued").otherwise("failed")
    return log.join(F.broadcast(now), F.lit(True)).select("id", state.alias("state"))


#: Legal moves of a job.
MOVES = {"queued": ("running", "cancelled"), "running": ("done", "failed", "queued", "cancelled"), "failed": ("queued",), "done": (), "cancelled": ()}
_legal = " OR ".join(f"(prev = '{a}' AND state = '{b}')" for a, bs in MOVES.items() for b in bs)


@query("illegal_moves", f"WITH {EVENTS_SQL}, p AS (SELECT id, lag(state) OVER (PARTITION BY channel ORDER BY second, id) AS prev, state FROM log) SELECT prev, state, count(*) AS n FROM p WHERE prev IS NOT NULL AND NOT ({_legal}) GROUP BY ALL")
def illegal_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes that the table of legal moves does not have."""
    last = F.max(F.struct("second", "id", "state")).alias("last")
    earlier = lambda w: [F.lag("last.state").over(w).alias("earlier")]
    log = events(spark, sf_dir).select("channel", "id", "second", "state")
    log = latest.by_buckets(log, ["channel"], F.floor(F.col("second") / 3600), [last], earlier)
    prev = F.coalesce(F.lag("state").over(Window.partitionBy("channel", "_bucket").orderBy("second", "id")), "earlier")
    moves = log.select(prev.alias("prev"), "state").where("prev IS NOT NULL").groupBy("prev", "state").agg(F.count("*").alias("n"))
    legal = [F.struct(F.lit(a).alias("prev"), F.lit(b).alias("state")) for a, bs in MOVES.items() for b in bs]
    return moves.where(~F.array_contains(F.array(*legal), F.struct("prev", "state")))


@query(
    "notify_decisions",
    f"""WITH {EVENTS_SQL} SELECT id, CASE WHEN event_type = 'view' THEN 'disabled' WHEN event_type = 'click' AND value <= 50 THEN 'policy' WHEN event_type <> 'error' AND (second % 86400 >= 79200 OR second % 86400 < 25200) THEN 'quiet_hours' ELSE 'send' END AS decision FROM log""",
)
def notify_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disabled kinds, then policy, then quiet hours over midnight; errors are exempt from these."""
    kind, day = F.col("event_type"), F.col("second") % 86400
    decision = (
        F.when(kind == "view", "disabled").when((kind == "click") & (F.col("value") <= 50), "policy")
        .when((kind != "error") & ((day >= 79200) | (day < 25200)), "quiet_hours").otherwise("send")
    )
    return events(spark, sf_dir).select("id", decision.alias("decision"))


@query("http_classes", "SELECT event_id, CASE WHEN c = 200 THEN 'none' WHEN c = 429 THEN 'backoff' WHEN c IN (401, 403) OR c >= 500 THEN 'rotate' ELSE 'fatal' END AS class FROM (SELECT event_id, [200, 401, 403, 404, 410, 429, 500, 503][1 + event_id % 8] AS c FROM events)")
def http_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, (200, 401, 403, 404, 410, 429, 500, 503)))
    c = F.get(codes, (F.col("id") % 8).cast("int"))
    kind = F.when(c == 200, "none").when(c == 429, "backoff").when(c.isin(401, 403) | (c >= 500), "rotate").otherwise("fatal")
    return events(spark, sf_dir).select(F.col("id").alias("event_id"), kind.alias("class"))


@query(
    "token_bucket",
    f"""WITH {EVENTS_SQL}, o AS (SELECT channel, list(second ORDER BY second, id) AS ts FROM log GROUP BY channel)
SELECT channel, CAST(len(ts) AS BIGINT) AS calls, list_reduce(ts[2:], lambda a, t: struct_pack(at := t, n := CASE WHEN least(a.n + (t - a.at), 600) >= 60 THEN least(a.n + (t - a.at), 600) - 60 ELSE least(a.n + (t - a.at), 600) END, waited := a.waited + CASE WHEN least(a.n + (t - a.at), 600) >= 60 THEN 0 ELSE 1 END), struct_pack(at := ts[1], n := 540::BIGINT, waited := 0)).waited AS waited FROM o""",
)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that a bucket of ten tokens, one a minute, would have made wait (in sixtieths)."""
    ts = F.transform(F.array_sort(F.collect_list(F.struct("second", "id"))), lambda x: x.second)
    start = F.struct(F.get("ts", F.lit(0)).alias("at"), F.lit(600).cast("long").alias("n"), F.lit(0).cast("long").alias("waited"))

    def fold(s, t):
        have = F.least(s["n"] + (t - s["at"]), F.lit(600).cast("long"))
        ok = have >= 60
        return F.struct(t.alias("at"), F.when(ok, have - 60).otherwise(have).alias("n"), (s["waited"] + (~ok).cast("long")).alias("waited"))

    per = events(spark, sf_dir).groupBy("channel").agg(ts.alias("ts"))
    return per.select("channel", F.size("ts").cast("long").alias("calls"), F.aggregate("ts", start, fold, lambda s: s["waited"]).alias("waited"))
