"""Polling and caching as stateful streams: state by key, expiry in the state, no static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.tables import EVENTS_SQL, events, table
from ..streaming.processors import BUCKETS, KNOWN_FOR, LONGEST, SHORTEST, TTL, Cache, PollStep
from ..streaming.tables import arriving, settled, state_on_disk
from .registry import query

POLL_COLUMNS = "channel long, poll long, fresh long, overflow boolean, seen long, rate double, seconds double"


def poll_steps(responses: DataFrame) -> DataFrame:
    """What the poll step makes of a stream of responses (channel, poll, posts: id and second).

    A channel's responses must come in poll order from batch to batch; within one they may lie as
    they like. An empty response is a poll without posts.
    """
    ids = F.col("posts.id")
    rows = responses.select(
        F.pmod(F.xxhash64("channel"), F.lit(BUCKETS)).alias("bucket"), "channel", "poll",
        F.array_compact(F.array_distinct(ids)).alias("ids"), F.exists(ids, lambda i: i.isNull()).alias("blank"),
        F.array_min("posts.second").alias("oldest"), F.array_max("posts.second").alias("newest"),
    )
    return rows.groupBy("bucket").transformWithStateInPandas(PollStep(), POLL_COLUMNS, "update", "processingTime")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as feed responses: a poll is a channel's hour, a post an event that is no error,
    known by the number in its properties."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    log = events(spark, sf_dir).join(e, F.col("id") == F.col("event_id"))
    post = F.when(F.col("event_type") != "error", F.struct(F.col("k").alias("id"), "second"))
    return log.groupBy("channel", F.floor(F.col("second") / 3600).alias("poll")).agg(F.collect_list(post).alias("posts"))


@query(
    "stream_poll_step",
    f"""WITH {EVENTS_SQL}, k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
l AS (SELECT channel, second // 3600 AS poll, second, event_type <> 'error' AS post, k FROM log JOIN k ON id = event_id),
ids AS (SELECT channel, poll, k, lag(poll) OVER (PARTITION BY channel, k ORDER BY poll) AS prior FROM (SELECT DISTINCT channel, poll, k FROM l WHERE post)),
n AS (SELECT channel, poll, count(*) FILTER (prior IS NULL OR poll - prior > {KNOWN_FOR}) AS fresh FROM ids GROUP BY ALL),
p AS (SELECT channel, poll, coalesce(max(fresh), 0) AS fresh, min(second) FILTER (post) AS oldest, max(second) FILTER (post) AS newest FROM l LEFT JOIN n USING (channel, poll) GROUP BY ALL),
w AS (SELECT *, max(newest) OVER (PARTITION BY channel ORDER BY poll) AS seen, coalesce(oldest > max(newest) OVER (PARTITION BY channel ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overflow,
 row_number() OVER (PARTITION BY channel ORDER BY poll) AS i, fresh / (poll - lag(poll) OVER (PARTITION BY channel ORDER BY poll))::DOUBLE AS observed FROM p),
r AS (SELECT *, i - coalesce(max(CASE WHEN fresh > 0 THEN i END) OVER (PARTITION BY channel ORDER BY poll), 0) AS empty,
 CASE WHEN i > 1 THEN list_reduce(list_filter(list(observed) OVER (PARTITION BY channel ORDER BY poll), lambda x: x IS NOT NULL), lambda a, x: 0.3 * x + 0.7 * a) END AS rate FROM w),
s AS (SELECT *, CASE WHEN coalesce(rate, 0) <= 0 THEN {LONGEST} ELSE least(greatest(60 / rate * 3600 * (1 + 0.5 * least(empty, 6)), {SHORTEST}), {LONGEST}) END AS base FROM r)
SELECT channel, poll, CAST(fresh AS BIGINT) AS fresh, overflow, seen, CAST(rate AS DOUBLE) AS rate, CAST(CASE WHEN overflow THEN greatest(base / 2, {SHORTEST}) ELSE base END AS DOUBLE) AS seconds FROM s""",
)
def stream_poll_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The poll step over responses that arrive in four steps."""
    with state_on_disk(spark, idle=False):
        rows, arrivals = arriving(written(responses(spark, sf_dir), "responses"), "poll")
        return settled(poll_steps(rows), ["channel", "poll"], arrivals=arrivals)


def cache_counts(requests: DataFrame) -> DataFrame:
    """(url, hits, misses, replaced, expired) of a stream of requests (url, id, second, at, put)."""
    schema = "url long, " + ", ".join(f"{c} long" for c in Cache.COUNTS)
    return requests.withWatermark("at", "0 seconds").groupBy("url").transformWithStateInPandas(Cache(), schema, "update", "eventTime")


@query(
    "stream_cache",
    f"""WITH RECURSIVE {EVENTS_SQL}, r AS (SELECT id % 97 AS url, second, id, event_type = 'purchase' AS put FROM log),
n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY second, id) AS i FROM r),
f(url, i, until, hits, misses, replaced, expired) AS (SELECT DISTINCT url, 0::BIGINT, CAST(NULL AS BIGINT), 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM n
 UNION ALL SELECT f.url, n.i, CASE WHEN n.put OR coalesce(f.until <= n.second, true) THEN n.second + {TTL} ELSE f.until END,
  hits + (NOT n.put AND coalesce(f.until > n.second, false))::BIGINT, misses + (NOT n.put AND coalesce(f.until <= n.second, true))::BIGINT,
  replaced + (n.put AND coalesce(f.until > n.second, false))::BIGINT, expired + coalesce(f.until <= n.second, false)::BIGINT
  FROM f JOIN n ON n.url = f.url AND n.i = f.i + 1)
SELECT url, hits, misses, replaced, expired + (until <= (SELECT max(second) FROM log))::BIGINT AS expired FROM f QUALIFY row_number() OVER (PARTITION BY url ORDER BY i DESC) = 1""",
)
def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache with expiry over requests that arrive in four steps; entries that are not used again
    leave by their timers once the stream's time has passed theirs."""
    log = events(spark, sf_dir).select((F.col("id") % 97).alias("url"), "id", "second", (F.col("event_type") == "purchase").alias("put"))
    with state_on_disk(spark):
        rows, arrivals = arriving(log.withColumn("at", F.timestamp_seconds("second")), "second")
        return settled(cache_counts(rows), ["url"], arrivals=arrivals)
