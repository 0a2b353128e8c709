"""Records that a run leaves behind: payloads of signals, scores, calls, overflow and degradation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import EVENTS_SQL, LEADS_SQL, events, leads, table
from .desk import first_failures
from .registry import query
from .runs import overflowed
from .scoring import FEATURES_SQL, JUDGED_SQL, judged, scored
from .sites import PRICE

_strings = "'[' || array_to_string(list_transform({}, lambda x: '\"' || x || '\"'), ',') || ']'"


@query(
    "local_signals",
    f"""WITH p AS (SELECT page_id, contains(html, '<nav') AS seen, list_sort(list_distinct(regexp_extract_all(html, '{PRICE}'))) AS prices, list_sort(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS links FROM pages)
SELECT page_id, '{{"prices":' || {_strings.format("prices")} || CASE WHEN seen THEN ',"links":' || {_strings.format("links")} ELSE ',"markup_not_observed":true' END || '}}' AS payload,
 CASE WHEN len(links) > 0 THEN {_strings.format("links")} END AS links FROM p""",
)
def local_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's signals as JSON. What comes from markup is left out, and said to be, where none was
    seen: an empty list would say that there is none. Lists alone are null where they are empty."""
    of = lambda pattern, i: F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), i)))
    links, seen = of('<a href="([^"]*)"', 1), F.contains("html", F.lit("<nav"))
    rows = table(spark, sf_dir, "pages").select("page_id", seen.alias("seen"), of(f"({PRICE})", 1).alias("prices"), links.alias("links"))
    fields = F.struct("prices", F.when(F.col("seen"), F.col("links")).alias("links"), F.when(~F.col("seen"), F.lit(True)).alias("markup_not_observed"))
    return rows.select("page_id", F.to_json(fields, {"ignoreNullFields": "true"}).alias("payload"), F.when(F.size("links") > 0, F.to_json("links")).alias("links"))


#: What a run's state is called where it is not at work on a channel.
STAGES = {"queued": "Starting", "done": "Complete", "failed": "Failed", "cancelled": "Cancelled"}


@query(
    "stage_labels",
    f"""WITH {EVENTS_SQL}, r AS (SELECT run_id, arg_max(state, (second, id)) AS state, arg_max(channel, (second, id)) AS now, count(DISTINCT channel) AS total, count(DISTINCT channel) FILTER (state = 'done') AS done FROM log GROUP BY run_id)
SELECT run_id, CASE state {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGES.items())} ELSE 'Scraping c/' || now || ' (' || least(done + 1, total) || ' of ' || total || ')' END AS label FROM r""",
)
def stage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence on where each run stands."""
    last = lambda c: F.max_by(c, F.struct("second", "id"))
    r = events(spark, sf_dir).groupBy("run_id").agg(
        last("state").alias("state"), last("channel").alias("now"), F.count_distinct("channel").alias("total"), F.count_distinct(F.when(F.col("state") == "done", F.col("channel"))).alias("done")
    )
    label = F.concat(F.lit("Scraping c/"), "now", F.lit(" ("), F.least(F.col("done") + 1, F.col("total")), F.lit(" of "), "total", F.lit(")"))
    for state, name in STAGES.items():
        label = F.when(F.col("state") == state, name).otherwise(label)
    return r.select("run_id", label.alias("label"))


@query("collected_set", f"WITH {LEADS_SQL} SELECT id, subreddit FROM leads WHERE age_hours <= 24 * 14 AND coalesce(status, '') <> 'ignored' AND id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def collected_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the last fourteen days that nobody set aside and no audit holds."""
    audited = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return leads(spark, sf_dir).where("age_hours <= 24 * 14 AND coalesce(status, '') <> 'ignored'").select("id", "subreddit").join(audited, "id", "left_anti")


_PARTS = ("engagement", "recency")


@query(
    "prescore_records",
    f"""WITH {JUDGED_SQL}, {FEATURES_SQL} SELECT id, '{{' || {" || ',' || ".join(f"'\"{n}\":' || CAST(floor({n} * 1000 + 0.5) AS BIGINT)" for n in _PARTS)} || ',"reason":' || CASE WHEN reason IS NULL THEN 'null' ELSE '"' || reason || '"' END || '}}' AS components FROM scored""",
)
def prescore_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of a score: its parts in thousandths and the reason, as JSON in name order."""
    rows = scored(judged(leads(spark, sf_dir)))
    parts = [F.floor(F.col(n) * 1000 + 0.5).cast("long").alias(n) for n in _PARTS]
    return rows.select("id", F.to_json(F.struct(*parts, "reason"), {"ignoreNullFields": "false"}).alias("components"))


@query("call_records", f"WITH {EVENTS_SQL} SELECT id, event_type AS stage, id % 4 + 1 AS attempt, cached + uncached AS tokens_in, out_tokens AS tokens_out, CASE WHEN event_type = 'error' THEN 'failed' WHEN id % 4 > 0 THEN 'retried' ELSE 'ok' END AS outcome, prefix FROM log")
def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record an attempt of a model call; a failed one has its record too."""
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("id") % 4 > 0, "retried").otherwise("ok")
    return events(spark, sf_dir).select(
        "id", F.col("event_type").alias("stage"), (F.col("id") % 4 + 1).alias("attempt"), (F.col("cached") + F.col("uncached")).alias("tokens_in"), F.col("out_tokens").alias("tokens_out"), outcome.alias("outcome"), "prefix"
    )


@query(
    "overflow_events",
    f"""WITH {EVENTS_SQL}, p AS (SELECT run_id, channel, second // 3600 AS poll, min(second) AS oldest, max(second) AS newest, count(*) AS n FROM log GROUP BY ALL),
o AS (SELECT run_id, channel, n, oldest > lag(newest) OVER (PARTITION BY run_id, channel ORDER BY poll) AS over FROM p)
SELECT run_id, channel, 'error' AS level, '{{"polls":' || count(*) || ',"seen":' || CAST(sum(n) AS BIGINT) || '}}' AS data FROM o WHERE over GROUP BY run_id, channel""",
)
def overflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error event for every channel of a run that may have missed posts."""
    return overflowed(spark, sf_dir).select("run_id", "channel", F.lit("error").alias("level"), F.to_json(F.struct("polls", "seen")).alias("data"))


@query(
    "degradation_messages",
    f"""WITH {EVENTS_SQL}, n AS (SELECT run_id, channel % 2 AS via, arg_min(id, (second, id)) AS id, count(*) - 1 AS repeats FROM log WHERE event_type = 'error' GROUP BY ALL)
SELECT run_id, '*Run ' || run_id || ' — egress degraded*' || chr(10) || 'Degradations: ' || count(*) || string_agg(chr(10) || 'exit ' || via || ': job ' || id || ', again ' || repeats, '' ORDER BY via)
 || chr(10) || 'Collection continued on the next rung of the ladder.' AS message FROM n GROUP BY run_id""",
)
def degradation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each way out of a run that failed: its first failed job and how often again."""
    bad = events(spark, sf_dir).where("event_type = 'error'").withColumn("state", F.col("channel") % 2)
    line = F.concat(F.lit("\nexit "), "state", F.lit(": job "), "id", F.lit(", again "), "repeats")
    per = first_failures(bad).groupBy("run_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("state", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x.line), "")
    return per.select("run_id", F.concat(F.lit("*Run "), "run_id", F.lit(" — egress degraded*\nDegradations: "), "n", body, F.lit("\nCollection continued on the next rung of the ladder.")).alias("message"))
