"""Relations of the analytics model, derived from the given tables.

The tables hold no discussion posts, so authors, votes, comment counts, times and states are a
stated arithmetic of the id (synthetic by design, with shares of unknowns, deleted authors and
bots); the SQL of every query spells the same derivation in LEADS_SQL and its siblings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed clock of every query.
NOW = "2026-08-15 12:00:00"

_LEAD = {
    "id": "doc_id",
    "subreddit": "source",
    "author": "CASE doc_id % 11 WHEN 0 THEN '[deleted]' WHEN 1 THEN 'AutoModerator' WHEN 2 THEN 'SomeBot' WHEN 3 THEN 'data_bot' WHEN 4 THEN NULL ELSE concat('user', CAST(doc_id % 97 AS VARCHAR(20))) END",
    "score": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id * 37 % 211 END",
    "num_comments": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 13 % 83 END",
    "age_hours": "doc_id * 17 % 1080",
    "status": "CASE doc_id % 6 WHEN 0 THEN 'contacted' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'ignored' ELSE 'new' END",
}
_REST = ", ".join(f"{v} AS {k}" for k, v in _LEAD.items())

#: CTE leads: title is the text up to its first line end, body what follows.
LEADS_SQL = f"""leads AS (SELECT {_REST},
  CASE WHEN strpos(text, chr(10)) = 0 THEN text ELSE substr(text, 1, strpos(text, chr(10)) - 1) END AS title,
  CASE WHEN strpos(text, chr(10)) = 0 THEN '' ELSE substr(text, strpos(text, chr(10)) + 1) END AS body
  FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts: id, subreddit, author, score, num_comments, age_hours, status, title, body."""
    at = F.expr("instr(text, '\n')")
    return table(spark, sf_dir, "documents").select(
        *(F.expr(v).alias(k) for k, v in _LEAD.items()),
        F.when(at == 0, F.col("text")).otherwise(F.expr("substr(text, 1, instr(text, '\n') - 1)")).alias("title"),
        F.when(at == 0, "").otherwise(F.expr("substr(text, instr(text, '\n') + 1)")).alias("body"),
    )


#: Columns of the event log as calls, jobs and polls; `second` is the time in epoch seconds.
_EVENT = {
    "id": "event_id",
    "run_id": "user_id % 20",
    "channel": "user_id",
    "state": "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'queued' WHEN 'view' THEN 'done' WHEN 'signup' THEN 'running' ELSE 'cancelled' END",
    "event_type": "event_type",
    "value": "value",
    "cached": "event_id * 31 % 1000",
    "uncached": "event_id * 17 % 500",
    "out_tokens": "event_id * 7 % 300",
    "latency_ms": "event_id * 73 % 4001",
    "prefix": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('p', CAST(event_id % 23 AS VARCHAR(20))) END",
}
_EVENTS = ", ".join(f"{v} AS {k}" for k, v in _EVENT.items())
EVENTS_SQL = f"log AS (SELECT {_EVENTS}, CAST(floor(epoch(ts)) AS BIGINT) AS second FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log: jobs, model calls and polls, one row an event."""
    cols = [F.expr(v).alias(k) for k, v in _EVENT.items()]
    second = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
    return table(spark, sf_dir, "events").select(*cols, F.expr(second).alias("second"))
