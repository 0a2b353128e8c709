"""Benchmark decontamination by winnowing.

k-grams of words are hashed where a text is read, and of every window of consecutive k-grams
the minimum is kept (the rightmost of equal ones), so any shared span of window + k - 1 words
shares a kept fingerprint. Fingerprints that a fixed-size bitmap of the benchmark's
fingerprints rules out stay in their task; the rest join the benchmark's on their hash, and
each match is extended word by word in both directions. Benchmark items shorter than a span
are one k-gram of their own length. The bitmap only saves shuffling: the join decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import ALNUM, arrow_schema, batched, small, table, tidy, utf8, written

SPAN, K = 13, 5
#: Bits of the bitmap, as a power of two: 4 MB whatever the benchmark's size.
BITMAP = 25
#: Words whose hashes a worker remembers.
REMEMBERED = 150_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxh64_intdigest(word)
        return h


_seen = _Hashes()


def forget() -> None:
    """Drops the worker's remembered words."""
    _seen.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_seen) > REMEMBERED:
        _seen.clear()
    return np.fromiter(map(_seen.__getitem__, words), np.uint64, len(words))


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """A mixed polynomial hash of every k consecutive entries of h."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def winnowed(g: np.ndarray, owner: np.ndarray, window: int, span: int) -> np.ndarray:
    """Positions of the rightmost minimum of each window of g whose span words have one owner."""
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = g[:n].copy()
    for i in range(1, window):
        np.minimum(low, g[i : i + n], out=low)
    whole = owner[:n] == owner[span - 1 : span - 1 + n]
    at = np.zeros(n, np.int64)
    for i in range(window):
        at[g[i : i + n] == low] = i
    mark = np.zeros(len(g), bool)
    mark[(np.arange(n) + at)[whole]] = True
    return np.flatnonzero(mark)


def _matches(texts: list[bytes], lengths: list[int], span: int, k: int, bits: np.ndarray | None) -> list[tuple]:
    """(index of text, fp, n, left, context, positions) for what may be shared; n is 0 for
    winnowed k-grams, else the length of a whole short item. Contexts hold what can extend a
    match; equal ones of a text come once."""
    words = [t.translate(ALNUM).split() for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    start = np.r_[0, np.cumsum(size)]
    owner = np.repeat(np.arange(len(words)), size)
    h = word_hashes([w for ws in words for w in ws])
    found: dict[tuple, list[int]] = {}
    for n in [0, *lengths]:
        g = kgrams(h, n or k)
        if n:
            at = np.flatnonzero(owner[: len(g)] == owner[n - 1 : n - 1 + len(g)])
        else:
            at = winnowed(g, owner, span - k + 1, span)
        if bits is not None and len(at):
            b = g[at] >> np.uint64(64 - BITMAP)
            at = at[(bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1]
        fps = g[at].view(np.int64).tolist()
        for p, d, fp in zip((at - start[owner[at]]).tolist(), owner[at].tolist(), fps, strict=True):
            lo = p if n else max(0, p - (span - k))
            hi = p + n if n else p + span
            found.setdefault((d, fp, n, p - lo, b" ".join(words[d][lo:hi])), []).append(p)
    return [(*key, at) for key, at in found.items()], size.tolist()


def extended(left: int, a: list[bytes], other: int, b: list[bytes], k: int) -> tuple[int, int]:
    """Words before the k-gram and from it on that both contexts share."""
    lo = 0
    while lo < min(left, other) and a[left - lo - 1] == b[other - lo - 1]:
        lo += 1
    hi = 0
    while left + hi < len(a) and other + hi < len(b) and a[left + hi] == b[other + hi]:
        hi += 1
    return lo, hi


FOUND = "fp long, n int, left int, context binary"


def _items(benchmark: DataFrame, lengths: list[int], span: int, k: int) -> DataFrame:
    schema = arrow_schema(f"item_id string, {FOUND}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows, size = _matches(texts, lengths, span, k, None)
            rows = [(ids[d], fp, n, left, c) for d, fp, n, left, c, _ in rows if not n or n == size[d]]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    src = benchmark.select(F.col("item_id").cast("string"), utf8().alias("text"))
    return src.mapInArrow(tidy(run, forget), f"item_id string, {FOUND}")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are lower-cased runs outside the ASCII non-alphanumerics; a null text has none. A
    window is span consecutive item words, or a whole shorter item; a document word inside an
    occurrence of a window is hit. contaminated: n_hit > 0 and 20 * n_hit >= n_words. Items
    without words, null items and an empty benchmark hit nothing. Rows are told apart by
    (doc_id, text); rows that repeat both each get the same result. Null ids stay null.
    """
    spark = docs.sparkSession
    batched(spark)
    n_words = F.size(F.expr(r"filter(split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), w -> w <> '')"))
    lengths = sorted(r[0] for r in benchmark.where("text is not null").select(n_words.alias("n")).where(f"n between 1 and {span - 1}").distinct().collect())
    items = written(_items(benchmark, lengths, span, k), "bench_prints")
    items = items.groupBy("fp", "n", "left", "context").agg(F.collect_set("item_id").alias("items"))
    items = written(items, "bench")
    bit = F.shiftrightunsigned("fp", 64 - BITMAP)
    bits = np.zeros(1 << (BITMAP - 6), np.uint64)
    one = F.expr("shiftleft(1L, cast(b & 63 as int))")
    for w, v in items.select(bit.alias("b")).groupBy((F.shiftright("b", 6)).alias("w")).agg(F.bit_or(one).alias("v")).collect():
        bits[w] = np.uint64(v & 0xFFFFFFFFFFFFFFFF)
    shared = spark.sparkContext.broadcast(bits)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, text_hash long, n_words long, found array<struct<fp: long, n: int, left: int, context: binary, at: array<int>>>"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = _matches(b.column(2).to_pylist(), lengths, span, k, shared.value)
            found: list[list] = [[] for _ in size]
            for d, fp, n, left, c, at in rows:
                found[d].append({"fp": fp, "n": n, "left": left, "context": c, "at": at})
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(found, schema.field(3).type)], schema=schema)

    src = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8().alias("text"))
    scanned = written(src.mapInArrow(tidy(run, forget), ddl), "scanned")
    cand = scanned.select("doc_id", "text_hash", F.inline("found"))
    pairs = cand.join(items.withColumnRenamed("left", "other").withColumnRenamed("context", "theirs"), ["fp", "n"])
    out = f"doc_id {kind}, text_hash long, spans array<struct<s: int, e: int>>, items array<string>"
    out_schema = arrow_schema(out)

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, n_, left, ctx, at, other, theirs, items_ = (b.column(i).to_pylist() for i in range(9))
            rows = []
            for i in range(len(n_)):
                if n_[i]:
                    lo, hi = (0, n_[i]) if ctx[i] == theirs[i] else (0, 0)
                else:
                    lo, hi = extended(left[i], ctx[i].split(), other[i], theirs[i].split(), k)
                if hi >= (n_[i] or k) and lo + hi >= (n_[i] or span):
                    rows.append((ids[i], hashes[i], [{"s": p - lo, "e": p + hi} for p in at[i]], items_[i]))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)

    hits = pairs.select("doc_id", "text_hash", "n", "left", "context", "at", "other", "theirs", "items").mapInArrow(tidy(extend), out)
    hits = hits.groupBy("doc_id", "text_hash").agg(
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x.s, x.e - 1)))))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), hit.cast("long").alias("hit"), "items")
    rows = scanned.select("doc_id", "text_hash", "n_words")
    done = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return done.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; columns as they are."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    bad = small(written(bad.distinct(), "contaminated"))
    on = docs["doc_id"].eqNullSafe(bad["d"]) & (F.xxhash64(docs["text"]) == bad["h"])
    return docs.join(bad, on, "left_anti")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("text_hash")


WORDS = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({WORDS.format("text")}, []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n,
        array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
