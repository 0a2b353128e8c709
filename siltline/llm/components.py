"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a groupBy/min with map-side combining and a join whose two sides are read from
written tables, so adaptive execution can split a hub's edges over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
    return (
        both.where("v > u")
        .join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    low = written(edges.groupBy("u").agg(F.min("v").alias("m")), "low")
    kept = low.select("u", F.col("m").alias("v"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(kept).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    edges: two long columns u and v; null ends and loops are ignored, repeated and reversed
    edges count once, an empty table gives an empty result. Raises when max_rounds (far above
    the logarithmic number of rounds needed) do not suffice.
    """
    edges = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = _mark(edges)
    for _ in range(max_rounds):
        new = written(_small_star(written(_large_star(edges), "large")), "small")
        discard(edges)
        edges, before = new, mark
        mark = _mark(edges)
        if mark == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    raise RuntimeError("connected components did not settle")
