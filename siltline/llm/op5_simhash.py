"""SimHash near-duplicates by a binary-trie self-join of the fingerprints.

1. Fingerprints: 64 bits per text from XXH64 of its word shingles, made where the text is read.
2. Distinct fingerprints are dealt to keys: of six bit blocks two fingerprints with at most
   four differing bits agree on at least two, so each of the 15 block pairs is a key and no
   link is lost. A key with many fingerprints is cut into slices, and its tasks take two
   slices each, so no task receives an unbounded key.
3. A task sorts its fingerprints into a binary trie and walks pairs of nodes together, adding
   up differing bits; a pair is pruned when the bits exceed the budget, or when both nodes lie
   in one component already. It emits a spanning forest, never all pairs.
4. Connected components of those forests give the groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import arrow_schema, batched, by_rows, table, tidy, utf8, written
from .components import connected_components

#: Bit widths of the six blocks, from the most significant bit.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of one key that one slice may hold.
SLICE = 4096
#: Rows that a task works on at once, rounded up to whole keys; node pairs that it expands at once.
TOGETHER = 1 << 17
FRONT = 1 << 18
SEED = 42


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; fewer words are one shingle, none give none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= k:
        return np.frombuffer(xxh64_digest(joined, SEED), ">u8").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    first = [0, *(ends[: n - k] + 1).tolist()]
    got = b"".join([xxh64_digest(joined[a:z], SEED) for a, z in zip(first, ends[k - 1 :].tolist(), strict=True)])
    return np.frombuffer(got, ">u8").astype(np.uint64)


def majority(h: np.ndarray, chunk: int = 1 << 16) -> bytes:
    """Eight bytes: a bit is 1 where over half of the hashes have it; no hashes: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), chunk):
        ones += np.unpackbits(h[at : at + chunk].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def fingerprint(text: bytes, k: int = 4) -> bytes:
    return majority(shingle_hashes(text, k))


def with_fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; null text counts as empty."""
    return by_rows(
        docs.select("doc_id", utf8().alias("text")),
        lambda b: {
            "doc_id": b["doc_id"],
            "fp": [int.from_bytes(fingerprint(x, k), "big", signed=True) for x in b["text"]],
        },
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long",
    )


def union_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (index of a root) after joining a[i] with b[i]."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        label = root[label]


def trie_forest(group: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints of each group within budget bits.

    group, fp: equal lengths, fp as uint64, no pair twice. The trie of a group is its sorted
    run of fp; a node at depth d is the range of rows that share the first d bits.
    """
    order = np.lexsort((fp, group))
    group, fp = group[order], fp[order]
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return fp[:0], fp[:0]
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    lo, hi = edge[:-1], edge[1:]
    several = hi - lo > 1
    lo, hi = lo[several], hi[several]
    ones: dict[int, np.ndarray] = {}
    turns = np.zeros(n, np.int64)  # how often the label changes up to each row

    def relabel(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label, turns
        label = union_labels(label, a, b)
        turns = np.r_[0, np.cumsum(label[1:] != label[:-1])]

    relabel(lo[:0], lo[:0])
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, a, az, b, bz, diff = stack.pop()
        if len(a) > FRONT:
            stack += [(depth, *(x[i : i + FRONT] for x in (a, az, b, bz, diff))) for i in range(0, len(a), FRONT)]
            continue
        single = (az - a == 1) & (bz - b == 1)
        if single.any():
            x, y = a[single], b[single]
            near = np.bitwise_count(fp[x] ^ fp[y]) <= budget
            if near.any():
                relabel(x[near], y[near])
        joined = (label[a] == label[b]) & (turns[az - 1] == turns[a]) & (turns[bz - 1] == turns[b])
        keep = ~(single | joined)
        if depth == 64 or not keep.any():
            continue
        a, az, b, bz, diff = (x[keep] for x in (a, az, b, bz, diff))
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((fp >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)]
        c = ones[depth]
        am, bm = az - (c[az] - c[a]), bz - (c[bz] - c[b])
        same, more = a == b, diff + np.int8(1)
        swap = ~same
        pairs = [
            (a, am, b, bm, diff),
            (am, az, bm, bz, diff),
            (a, am, bm, bz, more),
            tuple(x[swap] for x in (am, az, b, bm, more)),
        ]
        a, az, b, bz, diff = (np.concatenate(x) for x in zip(*pairs, strict=True))
        keep = (a < az) & (b < bz) & (diff <= budget) & ~((a == b) & (az - a == 1))
        stack.append((depth + 1, *(x[keep] for x in (a, az, b, bz, diff))))
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def _keys(fps: DataFrame, blocks: tuple[int, ...], agree: int) -> DataFrame:
    ends = np.cumsum(blocks)
    pairs = list(combinations(range(len(blocks)), agree))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            part = [(x >> np.uint64(64 - e)) & np.uint64((1 << w) - 1) for e, w in zip(ends, blocks)]
            for i, pair in enumerate(pairs):
                key = np.full(len(x), i, np.uint64)
                for p in pair:
                    key = (key << np.uint64(blocks[p])) | part[p]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["key", "fp"])

    return fps.mapInArrow(tidy(run), "key long, fp long")


def near_links(fps: DataFrame, budget: int = 4, blocks: tuple[int, ...] = BLOCKS, slice_rows: int = SLICE) -> DataFrame:
    """(u, v): links within budget bits that connect exactly what all such links connect.

    fps: a column fp of distinct longs. len(blocks) - budget blocks always agree.
    """
    batched(fps.sparkSession)
    keys = written(_keys(fps.select("fp"), blocks, len(blocks) - budget), "keys")
    large = keys.groupBy("key").count().where(F.col("count") > slice_rows)
    large = written(large.select("key", F.ceil(F.col("count") / slice_rows).cast("int").alias("g")), "large_keys")
    several = keys.groupBy("key").count().where("count > 1").select("key")
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    whole = keys.join(large, "key", "left_anti").join(several, "key", "left_semi").select("key", "fp", F.lit(0).alias("p"), F.lit(0).alias("q"))
    cut = (
        keys.join(large, "key")
        .withColumn("s", mine)
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("key", "fp", F.least("s", "t").alias("p"), F.greatest("s", "t").alias("q"))
    )
    schema = arrow_schema("u long, v long")

    def links(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, fp, p, q = (np.concatenate(x) for x in zip(*rows, strict=True))
        new = (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        u, v = trie_forest(np.r_[0, np.cumsum(new)], fp.view(np.uint64), budget)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in key order; a step takes whole keys, of at most two slices each
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if n >= TOGETHER:
                last = [h[-1] for i, h in enumerate(held[-1]) if i != 1]
                new = np.flatnonzero((cols[0] != last[0]) | (cols[2] != last[1]) | (cols[3] != last[2]))
                if len(new):
                    held.append(tuple(c[: new[0]] for c in cols))
                    yield links(held)
                    held, n, cols = [], 0, tuple(c[new[0] :] for c in cols)
            held.append(cols)
            n += len(cols[0])
        if held:
            yield links(held)

    dealt = whole.union(cut).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return dealt.mapInArrow(tidy(run), "u long, v long")


def simhash_groups(docs: DataFrame, k: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text; more may be there).

    component_id is the smallest doc_id that links of at most budget bits reach. Texts without
    words (null, empty) have fingerprint zero and link like any other. Repeated rows stay and
    share a component; a null doc_id stays and is never the smallest unless alone (then null).
    An empty table gives an empty result.
    """
    prints = written(with_fingerprints(docs, k), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = written(connected_components(near_links(nodes, budget)), "roots")
    linked = written(roots.join(nodes, roots.node == nodes.fp).select("node", "root", "low"), "linked")
    lows = written(linked.groupBy("root").agg(F.min("low").alias("component")), "lows")
    named = linked.join(lows, "root").select(F.col("node").alias("fp"), "component")
    named = nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id"))
    return prints.join(written(named, "named"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
