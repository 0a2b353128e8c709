"""Runs: group rows and snapshots as tables that appear together, membership, messages of a run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dedup_normal
from ..operators import latest
from ..sources.hashed import HASHED_SQL, hashed, norm_sql
from ..sources.runs import one_group_each, read_run, write_run
from ..sources.shared import shared_dir, written
from ..sources.tables import EVENTS_SQL, LEADS_SQL, events, leads, table
from .labels import _label, duration_label
from .registry import query


def group_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """rows (id, hash) as tables of groups (grp, size), members (grp, id) and hashes (id, hash)."""
    groups = rows.groupBy("hash").agg(F.min("id").alias("grp"), F.count("*").alias("size")).where("size > 1")
    members = rows.join(groups.select("hash", "grp"), "hash").select("grp", "id")
    return {"groups": groups.select("grp", "size"), "members": members, "hashes": rows.select("id", "hash")}


@query(
    "persisted_groups",
    f"""WITH {HASHED_SQL}, r AS (SELECT id % 3 AS run, id, hash FROM hashed), g AS (SELECT run, hash, min(id) AS grp, count(*) AS size FROM r GROUP BY ALL HAVING count(*) > 1)
SELECT CAST(run AS VARCHAR) AS run, grp, size, id, hash FROM g JOIN r USING (run, hash)""",
)
def persisted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of three runs, written and read back; run 1 is written twice and counts once."""
    base, rows = f"{shared_dir(spark)}/groups-{uuid.uuid4().hex}", written(hashed(spark, sf_dir).select("id", "hash"), "hashed")
    for run in (0, 1, 2, 1):
        tables = group_tables(rows.where(F.col("id") % 3 == run))
        write_run(spark, base, str(run), tables | {"members": one_group_each(tables["members"], "id", "grp")})
    groups, members, hashes = (read_run(spark, base, name) for name in ("groups", "members", "hashes"))
    return members.join(groups, ["run", "grp"]).join(hashes, ["run", "id"]).select("run", "grp", "size", "id", "hash")


@query(
    "snapshot_sink",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS site, html FROM pages)
SELECT site, page_id, length(html) AS n, sha256(html) AS fingerprint, CAST(2 AS BIGINT) AS snapshots FROM p""",
)
def snapshot_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots are only ever appended: two of equal pages are two, and the newest of each is read."""
    base, rows = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}", table(spark, sf_dir, "pages")
    site = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    shot = rows.select(site.alias("site"), "page_id", F.length("html").alias("n"), F.sha2("html", 256).alias("fingerprint"))
    for taken in (1, 2):
        write_run(spark, base, f"taken-{taken}", {"pages": shot.withColumn("taken", F.lit(taken))})
    all_ = read_run(spark, base, "pages").groupBy("page_id").agg(F.max_by(F.struct("site", "n", "fingerprint"), "taken").alias("s"), F.count("*").alias("snapshots"))
    return all_.select("s.site", "page_id", F.col("s.n").cast("long").alias("n"), "s.fingerprint", "snapshots")


@query(
    "membership_faults",
    f"""WITH {LEADS_SQL}, k AS (SELECT id, 'title' AS kind, {norm_sql("title")} AS t FROM leads UNION ALL SELECT id, 'body', {norm_sql("body")} FROM leads),
g AS (SELECT kind, t FROM k WHERE t <> '' GROUP BY ALL HAVING count(*) > 1) SELECT id, count(*) AS n FROM k JOIN g USING (kind, t) GROUP BY id HAVING count(*) > 1""",
)
def membership_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that are in more than one group where titles and bodies make groups of their own: what
    one_group_each would raise for."""
    posts = leads(spark, sf_dir)
    side = lambda c: posts.select("id", F.lit(c).alias("kind"), F.sha2(dedup_normal(F.col(c)), 256).alias("h"), (dedup_normal(F.col(c)) != "").alias("some"))
    keyed = side("title").unionByName(side("body")).where("some").select("id", "kind", "h")
    groups = keyed.groupBy("kind", "h").count().where("count > 1")
    return keyed.join(groups, ["kind", "h"]).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "failure_messages",
    f"""WITH {EVENTS_SQL}, p AS (SELECT run_id, arg_max(id, (second, id)) FILTER (state = 'failed') AS last_failed, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) AS seen, max(second) - min(second) AS s FROM log GROUP BY run_id)
SELECT run_id, '*Run ' || run_id || ' FAILED*' || chr(10) || 'Error: ' || coalesce('job ' || last_failed || ' failed', 'no error was recorded') || chr(10) || 'Jobs done: ' || done || chr(10) || 'Jobs failed: ' || failed || chr(10) || 'Posts scanned: ' || seen
 || chr(10) || 'Duration: ' || {_label} || chr(10) || 'Collected work has been kept.' AS message FROM p""",
)
def failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a failed run kept, beside what broke."""
    bad = F.col("state") == "failed"
    p = events(spark, sf_dir).groupBy("run_id").agg(
        F.max_by("id", F.when(bad, F.struct("second", "id"))).alias("last"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(bad).alias("failed"),
        F.count("*").alias("seen"), (F.max("second") - F.min("second")).alias("s"),
    )
    error = F.when(F.col("failed") > 0, F.concat(F.lit("job "), "last", F.lit(" failed"))).otherwise("no error was recorded")
    lines = ["*Run ", "run_id", " FAILED*\nError: ", error, "\nJobs done: ", "done", "\nJobs failed: ", "failed", "\nPosts scanned: ", "seen", "\nDuration: ", duration_label(F.col("s")), "\nCollected work has been kept."]
    return p.select("run_id", F.concat(*(x if not isinstance(x, str) or x in p.columns else F.lit(x) for x in lines)).alias("message"))


def overflowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, channel, polls, seen): the channels of runs with polls whose oldest post is newer than all before."""
    p = events(spark, sf_dir).groupBy("run_id", "channel", F.floor(F.col("second") / 3600).alias("poll")).agg(F.min("second").alias("oldest"), F.max("second").alias("newest"), F.count("*").alias("n"))
    before = lambda w: [F.lag("newest_").over(w).alias("before")]
    over = latest.by_buckets(p, ["run_id", "channel"], F.col("poll"), [F.max("newest").alias("newest_")], before).where("oldest > before")
    return over.groupBy("run_id", "channel").agg(F.count("*").alias("polls"), F.sum("n").alias("seen"))


@query(
    "overflow_messages",
    f"""WITH {EVENTS_SQL}, p AS (SELECT run_id, channel, second // 3600 AS poll, min(second) AS oldest, max(second) AS newest, count(*) AS n FROM log GROUP BY ALL),
o AS (SELECT run_id, channel, n, oldest > lag(newest) OVER (PARTITION BY run_id, channel ORDER BY poll) AS over FROM p), c AS (SELECT run_id, channel, count(*) AS polls, CAST(sum(n) AS BIGINT) AS seen FROM o WHERE over GROUP BY ALL)
SELECT run_id, '*Run ' || run_id || ' — watermark overflow*' || chr(10) || 'Channels affected: ' || count(*) || string_agg(chr(10) || 'c/' || channel || ': ' || polls || ' polls, ' || seen || ' seen', '' ORDER BY channel)
 || chr(10) || 'Posts may have been missed. The poll interval was halved.' AS message FROM c GROUP BY run_id""",
)
def overflow_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel of a run whose polls may have missed posts, a line each; a run has its few channels."""
    c = overflowed(spark, sf_dir)
    line = F.concat(F.lit("\nc/"), "channel", F.lit(": "), "polls", F.lit(" polls, "), "seen", F.lit(" seen"))
    lines = F.array_sort(F.collect_list(F.struct("channel", line.alias("line"))))
    per = c.groupBy("run_id").agg(F.count("*").alias("n"), F.array_join(F.transform(lines, lambda x: x.line), "").alias("body"))
    return per.select("run_id", F.concat(F.lit("*Run "), "run_id", F.lit(" — watermark overflow*\nChannels affected: "), "n", "body", F.lit("\nPosts may have been missed. The poll interval was halved.")).alias("message"))
