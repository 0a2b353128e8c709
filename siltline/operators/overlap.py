"""Exact similarity join of texts by their sets of shingles, without moving the sets.

A set is a function of its text, so it is made where it is needed and never written or dealt. Any
one order of all shingles makes prefixes exact; the order taken is by how often a shingle's bucket
is used, a table of BUCKETS counts that every task holds. Of two similar sets the smaller one's short
prefix and the larger one's prefix share the first shingle that both have. Sets meet by shingle and
class of size; a pair is a candidate unless sizes, places or marks rule it out. A set's marks are the
parities of BITS parts of it: each that differs stands for a shingle that only one of two sets has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the order of shingles, and a character that no text has.
BUCKETS, PAD = 1 << 19, 0x110000
#: Parities of a set, in longs of 64; a class of sizes spans this factor.
BITS, SPAN = 512, 1.25
WORDS = [f"w{i}" for i in range(BITS // 64)]
#: What rounding may change in a bound.
SLACK = 1e-9


def shingle_set(text: str, k: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the k-character substrings; a shorter text is one, an empty one none."""
    at = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if not len(at):
        return at
    at = np.append(at, np.full(max(k - len(at), 0), PAD, np.uint64))
    h = np.full(len(at) - k + 1, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(k):
        h = (h ^ at[i : i + len(h)]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ h >> np.uint64(32))


def bucket(s: np.ndarray) -> np.ndarray:
    return (s % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(one: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall in each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b["t"]:
                np.add.at(n, bucket(shingle_set(t)), 1)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": used.astype(np.int32), "n": n[used]})

    rows = one.select("t").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def marks(s: np.ndarray) -> np.ndarray:
    """The parities of a set's parts as longs."""
    odd = np.bincount((s >> np.uint64(40) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def size_class(n: int) -> int:
    return math.floor(math.log(n) / math.log(SPAN))


def prefixes(one: DataFrame, counts: np.ndarray, least: float) -> DataFrame:
    """(g, id, n, at, short, class, upto, marks) of the shingles in each set's prefix that another set
    may hold; class and upto: those of the set's size and of the largest that it may resemble."""
    held = one.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = held.value
        for b in batches:
            shingles, own = [np.zeros((2, 0), np.int64)], []
            for i, t in zip(b["id"], b["t"]):
                s = shingle_set(t)
                n = len(s)
                c = often[bucket(s)]
                first = np.lexsort((s, c))[: n - int(np.ceil(least * n - SLACK)) + 1]
                at = np.flatnonzero(c[first] > 1)  # a bucket used once has a shingle that meets none
                shingles.append(np.stack([s[first[at]].view(np.int64), at]))
                own.append((len(at), i, n, n - int(np.ceil(2 * least / (1 + least) * n - SLACK)) + 1, size_class(n), size_class(int(n / least + SLACK)), *marks(s)))
            g, at = np.concatenate(shingles, axis=1)
            times, *cols = np.array(own, np.int64).reshape(-1, 6 + len(WORDS)).T
            i, n, room, low, high, *words = (np.repeat(c, times) for c in cols)
            frame = pd.DataFrame({"g": g, "id": i, "n": n.astype(np.int32), "at": at.astype(np.int32), "short": at < room, "class": low.astype(np.int32), "upto": high.astype(np.int32)})
            yield frame.assign(**dict(zip(WORDS, words)))

    schema = "g long, id long, n int, at int, short boolean, class int, upto int, " + ", ".join(f"{w} long" for w in WORDS)
    return one.select("id", "t").mapInPandas(run, schema)


def candidates(prefix: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, of prefixes' rows: all pairs that may be similar, and few others."""
    cols = ("id", "n", "at", *WORDS)
    side = lambda rows, x: rows.select("g", "class", *(F.col(c).alias(f"{x}{c}") for c in cols))
    small = prefix.where("short").withColumn("class", F.explode(F.sequence("class", "upto")))
    nx, ny = F.col("xn"), F.col("yn")
    # shared shingles are at most this one and what is left of both sets behind it
    left = F.least(nx - F.col("xat"), ny - F.col("yat")) >= F.ceil(least / (1 + least) * (nx + ny) - SLACK)
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x{w}").bitwiseXOR(F.col(f"y{w}"))) for w in WORDS))
    alike = apart <= (1 - least) / (1 + least) * (nx + ny) + SLACK
    order = (nx < ny) | (nx == ny) & (F.col("xid") < F.col("yid"))
    met = side(small, "x").join(side(prefix, "y"), ["g", "class"]).where(order & (nx >= least * ny - SLACK) & left & alike)
    return met.select(F.least("xid", "yid").alias("a"), F.greatest("xid", "yid").alias("b")).distinct()


def measured(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b, x, y: texts) that are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, y in zip(batch["x"], batch["y"]):
                p, q = shingle_set(x), shingle_set(y)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                out.append(shared / (len(p) + len(q) - shared))
            rows = batch[["a", "b"]].assign(jaccard=np.array(out, np.float64))
            yield rows[rows["jaccard"] >= least]

    return pairs.select("a", "b", "x", "y").mapInPandas(run, "a long, b long, jaccard double")
