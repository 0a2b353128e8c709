"""Ordered work in two levels against one pass over each key."""

import random

from pyspark.sql import functions as F

from siltline.operators import latest


def test_running_sums_cross_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(40)]), i, rng.randrange(-5, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, id long, v long").repartition(7)
    got = latest.running(df, ["k"], F.floor(F.col("at") / 6), ["at", "id"], n=F.lit(1), total=F.col("v"))
    assert got.columns == ["k", "at", "id", "v", "n", "total"]
    want, seen = {}, {}
    for k, at, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        n, total = seen.get(k, (0, 0))
        want[i] = seen[k] = (n + 1, total + v)
    assert {r.id: (r.n, r.total) for r in got.collect()} == want


def test_neighbours_skip_empty_buckets(spark):
    rows = [("a", 1), ("a", 2), ("a", 95), ("a", 400), ("b", 7)]
    df = spark.createDataFrame(rows, "k string, at long")
    got = latest.by_buckets(df, ["k"], F.floor(F.col("at") / 10), [F.min("at").alias("opens")], lambda w: [F.lead("opens").over(w).alias("later")])
    assert {(r.k, r.at): r.later for r in got.collect()} == {("a", 1): 95, ("a", 2): 95, ("a", 95): 400, ("a", 400): None, ("b", 7): None}


def test_an_empty_table_stays_empty(spark):
    df = spark.createDataFrame([], "k string, at long")
    assert latest.running(df, ["k"], F.col("at"), ["at"], n=F.lit(1)).collect() == []
