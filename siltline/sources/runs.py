"""Results of a run as several tables that appear together or not at all.

A run's tables are written first, each under an attempt of its own; the manifest, one appended
row that names the attempt, comes last. Readers take what manifests name, of a run the newest, so
a job that ends between two tables leaves rows that nobody reads, and a run written again
replaces the earlier one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import written

_MANIFEST = "run string, number long, attempt string, counts map<string,long>"


def _manifests(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).option("ignoreMissingFiles", True).json(f"{base}/manifest")


def write_run(spark: SparkSession, base: str, run: str, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Writes tables as those of run, in place of what it had, and returns their rows."""
    attempt, counts = uuid.uuid4().hex, {}
    for name, rows in tables.items():
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{base}/data/{name}/attempt={attempt}")
        counts[name] = seen.get["n"]
    spark.createDataFrame([], _MANIFEST).write.mode("append").json(f"{base}/manifest")  # so that the folder is there
    number = _manifests(spark, base).agg(F.coalesce(F.max("number"), F.lit(0)) + 1).first()[0]
    spark.createDataFrame([(run, number, attempt, counts)], _MANIFEST).coalesce(1).write.mode("append").json(f"{base}/manifest")
    return counts


def read_run(spark: SparkSession, base: str, name: str) -> DataFrame:
    """run and the rows of table name of all runs that were written whole."""
    newest = _manifests(spark, base).groupBy("run").agg(F.max_by("attempt", F.struct("number", "attempt")).alias("attempt"))
    return spark.read.parquet(f"{base}/data/{name}").join(newest, "attempt").drop("attempt")


def one_group_each(members: DataFrame, key: str, group: str) -> DataFrame:
    """members as a written table; raises ValueError if a key is in two groups."""
    kept, seen = written(members, "members"), Observation()
    held = kept.groupBy(key).agg(F.count_distinct(group).alias("n"))
    held.observe(seen, F.count_if(F.col("n") > 1).alias("faults"), F.max(F.when(F.col("n") > 1, F.col(key))).alias("one")).write.format("noop").mode("overwrite").save()
    if seen.get["faults"]:
        raise ValueError(f"{seen.get['faults']} members are in several groups, such as {seen.get['one']}")
    return kept
