"""Structured-streaming forms: windowed counts, first copies and the feed diff."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import table
from ..streaming.tables import settled, stream
from .channels import POLLS_SQL
from .registry import query


@query(
    "stream_windows",
    "SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS hour, event_type, count(*) AS n, CAST(round(max(value), 6) AS DOUBLE) AS top FROM events GROUP BY ALL",
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour and kind under a watermark; the files at hand make one batch, so none is late."""
    e = stream(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    per = e.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    per = per.select(F.unix_timestamp("w.start").alias("hour"), "event_type", "n", F.round("top", 6).alias("top"))
    return settled(per, ["hour", "event_type"])


@query("stream_comment_dedup", "SELECT DISTINCT sha256(coalesce(text, '')) AS hash FROM conversations")
def stream_comment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comment text is stored once however often it comes; the state holds hashes only."""
    c = stream(spark, sf_dir, "conversations").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return settled(c.dropDuplicates(["hash"]), ["hash"], "append")


@query("stream_feed_diff", "SELECT doc_id, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY doc_id")
def stream_feed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming posts that the store does not hold: a stream joined to a static table."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("old", F.lit(True))
    fresh = stream(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").where("old IS NULL AND doc_id IS NOT NULL")
    return settled(fresh.groupBy("doc_id").agg(F.count("*").alias("n")), ["doc_id"])


def advanced(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A channel's cursor after a micro-batch: newest time seen, polls, empty polls in a row and the
    smoothed rate of new posts an hour. A poll is an hour of the log; an hour that goes on in a
    later batch is the same poll, so the state holds the last hour apart until a newer one comes.
    """
    seen, polls, empty, rate, at, hour, fresh = state.get if state.exists else (0, 0, 0, None, None, None, 0)
    counts: dict[int, int] = {}
    for b in batches:
        seen = max(seen, int(b["second"].max()))
        for h, n in b.assign(new=b["event_type"] != "error").groupby(b["second"] // 3600)["new"].sum().items():
            counts[int(h)] = counts.get(int(h), 0) + int(n)
    if hour is not None:
        counts[hour] = counts.get(hour, 0) + fresh

    def settle(h: int, n: int, empty: int, rate: float | None, at: int | None) -> tuple:
        observed = None if at is None else n / (h - at)
        return (0 if n else empty + 1), observed if rate is None else 0.3 * observed + 0.7 * rate, h

    hours = sorted(h for h in counts if at is None or h > at)
    polls += len(hours) - (hour is not None)
    for h in hours[:-1]:
        empty, rate, at = settle(h, counts[h], empty, rate, at)
    hour, fresh = hours[-1], counts[hours[-1]]
    state.update((seen, polls, empty, rate, at, hour, fresh))
    now_empty, now_rate, _ = settle(hour, fresh, empty, rate, at)
    yield pd.DataFrame({"channel": [key[0]], "last_seen": [seen], "n_polls": [polls], "empty_polls": [now_empty], "rate": [now_rate]}).astype({"rate": "float64"})


@query(
    "stream_cursor",
    f"""WITH {POLLS_SQL}, o AS (SELECT channel, list(struct_pack(p := poll, n := fresh, t := newest) ORDER BY poll) AS ps FROM polls GROUP BY channel),
f AS (SELECT channel, ps, list_transform(ps, lambda p, i: CASE WHEN i = 1 THEN CAST(NULL AS DOUBLE) ELSE p.n / (p.p - ps[i - 1].p)::DOUBLE END) AS rates FROM o)
SELECT channel, list_max(list_transform(ps, lambda p: p.t)) AS last_seen, len(ps) AS n_polls, CAST(len(ps) - list_max(list_prepend(0, list_transform(ps, lambda p, i: CASE WHEN p.n > 0 THEN i ELSE 0 END))) AS BIGINT) AS empty_polls,
 CASE WHEN len(ps) > 1 THEN CAST(round(list_reduce(list_filter(rates, lambda r: r IS NOT NULL), lambda a, r: 0.3 * r + 0.7 * a), 6) AS DOUBLE) END AS rate FROM f""",
)
def stream_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel's cursor, advanced batch by batch with its state kept by the stream."""
    e = stream(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("second"))
    out = "channel long, last_seen long, n_polls long, empty_polls long, rate double"
    kept = "seen long, polls long, empty long, rate double, at long, hour long, fresh long"
    rows = e.groupBy("channel").applyInPandasWithState(advanced, out, kept, "update", GroupStateTimeout.NoTimeout)
    return settled(rows.withColumn("rate", F.round("rate", 6)), ["channel"])
