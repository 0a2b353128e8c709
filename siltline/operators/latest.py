"""Keep-first, top-k and upsert patterns shared by the stores and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def by_buckets(df: DataFrame, keys: list[str], bucket: Column, parts: list[Column], across: Callable[[WindowSpec], list[Column]]) -> DataFrame:
    """df with _bucket and what across takes from the summaries (parts) of a key's other buckets.

    Ordered work over a key is done in two levels, so that no task orders all rows of a hot key:
    within (keys, _bucket), and over the buckets' summaries in order. bucket must rise with the
    order; keys and bucket may be null.
    """
    rows = df.withColumn("_bucket", bucket)
    names = [*keys, "_bucket"]
    w = Window.partitionBy(*keys).orderBy("_bucket")
    sums = rows.groupBy(*names).agg(*parts).select(*(F.col(n).alias(f"_of_{n}") for n in names), *across(w))
    same = [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names]
    return rows.join(sums, same).drop(*(f"_of_{n}" for n in names))


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], **values: Column) -> DataFrame:
    """df with the running sum of each of values along order, the row itself included."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = [F.sum(v).alias(f"_in_{n}") for n, v in values.items()]
    before = lambda w: [F.coalesce(F.sum(f"_in_{n}").over(upto(w)), F.lit(0)).alias(f"_before_{n}") for n in values]
    rows = by_buckets(df, keys, bucket, parts, before)
    here = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {n: F.sum(v).over(here) + F.col(f"_before_{n}") for n, v in values.items()}
    return rows.withColumns(sums).drop("_bucket", *(f"_before_{n}" for n in values))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """The page of a sorted table; number is at least 1, size from 1 to 500."""
    size = min(max(size, 1), 500)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def new_rows(incoming: DataFrame, stored: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows whose non-blank key is not stored yet, the first of each key."""
    usable = incoming.where(F.col(key).isNotNull() & (F.btrim(F.col(key).cast("string")) != ""))
    return keep_first(usable, [key], *order).join(stored.select(key).distinct(), key, "left_anti")


def first_wins(primary: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """The union by key in which primary's row wins."""
    both = primary.withColumn("_rank", F.lit(0)).unionByName(extra.withColumn("_rank", F.lit(1)))
    return keep_first(both, [key], F.col("_rank")).drop("_rank")


def upsert(old: DataFrame, new: DataFrame, key: str, values: list[str], protected: Column | None = None) -> DataFrame:
    """old with new's values by key, and new's further keys; protected rows of old keep theirs."""
    o, n = old.alias("o"), new.alias("n")
    keep = F.col(f"n.{key}").isNull() if protected is None else F.col(f"n.{key}").isNull() | F.coalesce(protected, F.lit(False))
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    action = F.when(F.col(f"o.{key}").isNull(), "insert").when(keep, "keep").otherwise("update")
    picked = [F.when(F.col(f"o.{key}").isNotNull() & keep, F.col(f"o.{v}")).otherwise(F.col(f"n.{v}")).alias(v) for v in values]
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *picked, action.alias("action"))
