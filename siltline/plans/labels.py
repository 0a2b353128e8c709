"""Small values that screens and messages show: durations, shares, windows, counts and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import EVENTS_SQL, LEADS_SQL, events, leads, table
from .registry import query

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
#: Settings as people write them, made of an event's own number.
_RAW = f"""CASE event_id % 7 WHEN 0 THEN concat(CAST({_K} AS VARCHAR(20)), 'm') WHEN 1 THEN concat(' ', CAST({_K} AS VARCHAR(20)), 'H ') WHEN 2 THEN concat(CAST({_K} AS VARCHAR(20)), 's') WHEN 3 THEN CAST({_K} AS VARCHAR(20)) WHEN 4 THEN '1.5d' WHEN 5 THEN 'soon' ELSE '' END"""


def duration_seconds(raw: Column, fallback: float) -> Column:
    """Seconds of a number with or without a unit (s, m, h, d); what is neither gives fallback."""
    t = F.lower(F.btrim(raw))
    unit = F.regexp_extract(t, "([smhd])$", 1)
    factor = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    number = F.regexp_extract(t, r"^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:e[+-]?[0-9]+)?)\s*[smhd]?$", 1)
    return F.coalesce(F.nullif(number, F.lit("")).try_cast("double") * factor, F.lit(float(fallback)))


def duration_label(seconds: Column) -> Column:
    """`42s`, `4m 02s` or `3h 07m`; null for negative or unknown ones."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    label = (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), two(s % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), two(F.floor(s % 3600 / 60)), F.lit("m")))
    )
    return F.when(s >= 0, label)


_label = "CASE WHEN s < 0 THEN NULL WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' END"


@query(
    "durations",
    f"""WITH r AS (SELECT event_id, lower(trim({_RAW})) AS t FROM events), p AS (SELECT event_id, CASE WHEN suffix(t, 'm') THEN 60 WHEN suffix(t, 'h') THEN 3600 WHEN suffix(t, 'd') THEN 86400 ELSE 1 END AS f, try_cast(regexp_replace(t, '[smhd]$', '') AS DOUBLE) AS n FROM r),
x AS (SELECT event_id, CAST(coalesce(n * f, 900) AS DOUBLE) AS seconds FROM p), y AS (SELECT event_id, seconds, CAST(floor(seconds) AS BIGINT) AS s FROM x) SELECT event_id, seconds, {_label} AS label FROM y""",
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", duration_seconds(F.expr(_RAW), 900).alias("seconds"))
    return rows.select("event_id", "seconds", duration_label(F.col("seconds")).alias("label"))


@query(
    "run_progress",
    f"""WITH {EVENTS_SQL}, p AS (SELECT run_id, count(*) AS total, count(*) FILTER (state IN ('done', 'failed', 'cancelled')) AS done, arg_max(state, (second, id)) AS last, max(second) - min(second) AS s FROM log GROUP BY run_id)
SELECT run_id, CAST(CASE WHEN last IN ('done', 'failed', 'cancelled') THEN 100 ELSE greatest(0, least(100, round_even(done * 100 / total::DOUBLE, 0))) END AS BIGINT) AS percent, {_label} AS lasted FROM p""",
)
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of finished jobs, a hundred once the run's newest state is an end, and how long it took."""
    ended = F.col("state").isin("done", "failed", "cancelled")
    p = events(spark, sf_dir).groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if(ended).alias("done"), F.max_by("state", F.struct("second", "id")).alias("last"), (F.max("second") - F.min("second")).alias("s")
    )
    share = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.col("done") * 100 / F.col("total"), 0).cast("long")))
    return p.select("run_id", F.when(F.col("last").isin("done", "failed", "cancelled"), 100).otherwise(share).cast("long").alias("percent"), duration_label(F.col("s")).alias("lasted"))


_WINDOW = f"concat(lpad(CAST({_K} % 26 AS VARCHAR(20)), 2, '0'), ':', lpad(CAST(event_id % 62 AS VARCHAR(20)), 2, '0'), CASE WHEN event_id % 5 = 0 THEN ' to ' ELSE '-' END, '07:30')"


@query(
    "quiet_windows",
    f"""WITH r AS (SELECT event_id, {_WINDOW} AS w FROM events), p AS (SELECT event_id, regexp_matches(w, '^[0-9]{{2}}:[0-9]{{2}}-[0-9]{{2}}:[0-9]{{2}}$') AS ok, CAST(substr(w, 1, 2) AS BIGINT) AS h, CAST(substr(w, 4, 2) AS BIGINT) AS m FROM r)
SELECT event_id, CASE WHEN ok AND h < 24 AND m < 60 THEN h * 60 + m END AS begins, CASE WHEN ok AND h < 24 AND m < 60 THEN 450 END AS ends FROM p""",
)
def quiet_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of the day at which a window HH:MM-HH:MM begins and ends; null where it is none."""
    w = F.expr(_WINDOW)
    part = lambda i: F.regexp_extract(w, r"^\s*(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})\s*$", i).try_cast("long")
    ok = (part(1) < 24) & (part(2) < 60) & (part(3) < 24) & (part(4) < 60)
    return table(spark, sf_dir, "events").select("event_id", F.when(ok, part(1) * 60 + part(2)).alias("begins"), F.when(ok, part(3) * 60 + part(4)).cast("int").alias("ends"))


_COUNT = f"CASE event_id % 5 WHEN 0 THEN concat('-', CAST({_K} AS VARCHAR(20))) WHEN 1 THEN 'true' WHEN 2 THEN NULL ELSE CAST({_K} AS VARCHAR(20)) END"


@query(
    "safe_counts",
    f"SELECT event_id, greatest(0, coalesce(try_cast({_COUNT} AS BIGINT), 0)) AS n, CASE WHEN try_cast({_COUNT} AS BIGINT) IS NULL THEN 25 ELSE least(100, greatest(1, try_cast({_COUNT} AS BIGINT))) END AS page, substr(sha256(CAST(user_id AS VARCHAR)), 1, 12) AS chat FROM events",
)
def safe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count from a payload (0 for what is none), a page size from 1 to 100, a chat's short digest."""
    n = F.expr(_COUNT).try_cast("long")
    page = F.when(n.isNull(), 25).otherwise(F.least(F.lit(100), F.greatest(F.lit(1), n)))
    return table(spark, sf_dir, "events").select(
        "event_id", F.greatest(F.lit(0), F.coalesce(n, F.lit(0))).alias("n"), page.alias("page"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 12).alias("chat")
    )


@query(
    "body_sources",
    f"WITH {LEADS_SQL} SELECT CASE WHEN regexp_matches(body, '\\S') THEN 'feed' ELSE 'absent' END AS source, count(*) AS n FROM leads GROUP BY 1",
)
def body_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("body").rlike(r"\S"), "feed").otherwise("absent")
    return leads(spark, sf_dir).groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@query(
    "stable_json",
    """SELECT event_id, '{"k":' || regexp_extract(props, '([0-9]+)', 1) || ',"kind":"' || event_type || '","user":' || user_id || '}' AS payload FROM events""",
)
def stable_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as JSON with fields in name order and no blanks."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("payload"))


#: Dollars for a million tokens of the provider models: cached input, other input, output.
PROVIDERS = {"alpha": (0.02, 1.0, 4.0), "beta": (0.5, 0.5, 1.5), "gamma": (0.0, 0.0, 0.0)}
_providers = ", ".join(f"('{n}', {i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (n, (a, b, c)) in enumerate(PROVIDERS.items()))


@query(
    "provider_costs",
    f"""WITH {EVENTS_SQL}, t AS (SELECT count(*) AS items, avg(cached) AS prefix, avg(uncached) AS item, avg(out_tokens) AS out FROM log), p(provider, place, hit, miss, output) AS (VALUES {_providers})
SELECT provider, place, CAST(round((prefix * hit + item * miss + out * output) * items / 1e6, 6) AS DOUBLE) AS warm, CAST(round(((prefix + item) * miss + out * output) * items / 1e6, 6) AS DOUBLE) AS cold FROM t, p""",
)
def provider_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log's calls would cost at each provider, all prefixes cached and none."""
    t = events(spark, sf_dir).agg(F.count("*").alias("items"), F.avg("cached").alias("prefix"), F.avg("uncached").alias("item"), F.avg("out_tokens").alias("out"))
    prices = F.array(*(F.struct(F.lit(n).alias("provider"), F.lit(i).alias("place"), *(F.lit(x).alias(c) for x, c in zip(p, ("hit", "miss", "output")))) for i, (n, p) in enumerate(PROVIDERS.items())))
    rows = t.select("*", F.inline(prices))
    warm = (F.col("prefix") * F.col("hit") + F.col("item") * F.col("miss") + F.col("out") * F.col("output")) * F.col("items") / 1e6
    cold = ((F.col("prefix") + F.col("item")) * F.col("miss") + F.col("out") * F.col("output")) * F.col("items") / 1e6
    return rows.select("provider", "place", F.round(warm, 6).alias("warm"), F.round(cold, 6).alias("cold"))


@query(
    "status_classes",
    f"""WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 400 + {_K} % 32 WHEN event_type = 'view' THEN 500 + {_K} % 5 ELSE 200 END AS code FROM events),
c AS (SELECT event_id, CASE code WHEN 401 THEN 'key' WHEN 402 THEN 'balance' WHEN 429 THEN 'rate' WHEN 400 THEN 'request' WHEN 422 THEN 'request' ELSE CASE WHEN code >= 500 THEN 'server' WHEN code >= 400 THEN 'other' END END AS class FROM s)
SELECT class, count(*) AS n, class IN ('rate', 'server') AS trips FROM c WHERE class IS NOT NULL GROUP BY class""",
)
def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of calls by class, and whether another provider would be worth a try."""
    k = F.expr(_K)
    code = F.when(F.col("event_type") == "error", 400 + k % 32).when(F.col("event_type") == "view", 500 + k % 5).otherwise(200)
    kind = F.when(code == 401, "key").when(code == 402, "balance").when(code == 429, "rate").when(code.isin(400, 422), "request").when(code >= 500, "server").when(code >= 400, "other")
    rows = table(spark, sf_dir, "events").select(kind.alias("class")).where("class is not null")
    return rows.groupBy("class").agg(F.count("*").alias("n")).withColumn("trips", F.col("class").isin("rate", "server"))


@query(
    "run_messages",
    f"""WITH {EVENTS_SQL}, p AS (SELECT run_id, count(*) AS n, count(*) FILTER (state = 'failed') AS bad, max(second) - min(second) AS s FROM log GROUP BY run_id)
SELECT run_id, '*Run ' || run_id || ' complete*' || chr(10) || 'Jobs: ' || n || CASE WHEN bad > 0 THEN ' (' || bad || ' failed)' ELSE '' END || chr(10) || 'Duration: ' || {_label} AS message FROM p""",
)
def run_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's message: jobs, failures where there are any, and its duration."""
    p = events(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "failed").alias("bad"), (F.max("second") - F.min("second")).alias("s"))
    bad = F.when(F.col("bad") > 0, F.concat(F.lit(" ("), "bad", F.lit(" failed)"))).otherwise("")
    return p.select("run_id", F.concat(F.lit("*Run "), "run_id", F.lit(" complete*\nJobs: "), "n", bad, F.lit("\nDuration: "), duration_label(F.col("s"))).alias("message"))
