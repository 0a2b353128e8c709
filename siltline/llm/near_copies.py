"""SimHash near-dedup of the pipeline: similar texts by exact Jaccard similarity of word shingles.

1. Every text's five-word shingles are hashed once (XXH64). The hashes give its set, its SimHash
   fingerprint and its MinHash keys. Equal sets are one node, so exact copies meet no one.
2. Candidates are the links of op5's trie self-join of the fingerprints. A pair of similarity 0.8
   differs in about ten of 64 bits, far beyond a budget that a trie can prune by, so 30 MinHash
   keys complete them: a pair of similarity s shares a key with probability 1 - (1 - s^5)^30,
   which is 0.99999 at 0.8. At first a node meets only the smallest node of each of its keys.
3. Every candidate is measured exactly on the hashes; similar ones are connected.
4. What shares a key but is not connected yet meets in cells of bounded size, which measure all
   their pairs as a product of incidence matrices and emit a spanning forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import by_rows, small, utf8, written
from .components import connected_components
from .op5_simhash import majority, near_links, shingle_hashes, union_labels

K, SIMILAR = 5, 0.8
#: Band keys of a text and MinHashes of one key.
BANDS, ROWS = 30, 5
#: Nodes of a slice, and their shingles, unless one text alone has more; two slices meet in a cell.
SLICE, SLICE_SHINGLES = 2048, 1 << 20
#: A shingle whose texts make at most so many pairs in a cell is counted pair by pair.
FEW = 64
_rng = np.random.default_rng(42)
_XOR, _MUL = (_rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_MIX = _rng.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_MUL |= np.uint64(1)


def shingle_set(text: bytes, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; a text without words has none."""
    return np.unique(shingle_hashes(text, k))


def keys_of(h: np.ndarray, chunk: int = 1024) -> tuple[int, list[int]]:
    """(node, band keys) of a set as signed longs; the empty set has no keys."""
    node = int(np.uint64(xxh64_intdigest(h.tobytes())).view(np.int64))
    if not len(h):
        return node, []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), chunk):
        np.minimum(least, ((h[at : at + chunk] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=least)
    return node, (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(a, b)
    shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return shared / (len(a) + len(b) - shared)


def overlaps(x: list[np.ndarray], y: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many hashes each set of x shares with each of y."""
    hx, hy = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(hx, hy)
    out = np.zeros(len(x) * len(y), np.int64)
    entries = []
    for h, sets in ((hx, x), (hy, y)):
        col = np.searchsorted(shared, h)
        there = (col < len(shared)) & (shared[np.minimum(col, len(shared) - 1)] == h) if len(shared) else np.zeros(len(h), bool)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[there]
        order = np.argsort(col[there], kind="stable")
        entries.append((col[there][order], row[order]))
    (cx, rx), (cy, ry) = entries
    nx, ny = np.bincount(cx, minlength=len(shared)), np.bincount(cy, minlength=len(shared))
    few = nx * ny <= FEW
    one = few[cx]
    times, first = ny[cx[one]], np.r_[0, np.cumsum(ny)][cx[one]]
    at = np.repeat(first - np.r_[0, np.cumsum(times)][:-1], times) + np.arange(times.sum())
    if len(at):
        out += np.bincount(np.repeat(rx[one], times) * len(y) + ry[at], minlength=len(out))
    out = out.reshape(len(x), len(y)).astype(np.float32)
    number = np.cumsum(~few) - 1
    bx, by = ~few[cx], ~few[cy]
    cx, rx, cy, ry = number[cx[bx]], rx[bx], number[cy[by]], ry[by]
    for c in range(0, int((~few).sum()), columns):
        a, b = np.zeros((len(x), columns), np.float32), np.zeros((len(y), columns), np.float32)
        for m, cols, rows in ((a, cx, rx), (b, cy, ry)):
            lo, hi = np.searchsorted(cols, [c, c + columns])
            m[rows[lo:hi], cols[lo:hi] - c] = 1
        out += a @ b.T
    return out


def cell_links(roots: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between roots that connect what the similar pairs of left and right rows connect.

    roots: each row's component so far; left, right: which rows are on each side.
    """
    name, label = np.unique(roots, return_inverse=True)
    i, j = np.flatnonzero(left), np.flatnonzero(right)
    size = np.array([len(s) for s in sets], np.float32)
    shared = overlaps([sets[n] for n in i], [sets[n] for n in j])
    similar = shared >= SIMILAR * (size[i][:, None] + size[j][None] - shared)
    a, b = np.nonzero(similar & (label[i][:, None] != label[j][None]))
    joined = union_labels(np.arange(len(name)), label[i[a]], label[j[b]])
    child = np.flatnonzero(joined != np.arange(len(name)))
    return name[child], name[joined[child]]


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): the pairs (a, b) of nodes that are similar; sets: (node, hs)."""
    slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("g"))
    left = sets.join(slices, sets.node == slices.a).select("a", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("s"), F.col("hs").alias("x"))
    right = pairs.join(slices, "a").withColumn("s", F.pmod(F.xxhash64("b"), F.col("g")).cast("int")).select("a", "b", "s")
    right = right.join(sets.select(F.col("node").alias("b"), F.col("hs").alias("y")), "b")

    def run(batch: dict[str, list]) -> dict[str, list]:
        out = {"u": [], "v": []}
        for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"], strict=True):
            if jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= SIMILAR:
                out["u"].append(a)
                out["v"].append(b)
        return out

    return by_rows(right.join(left, ["a", "s"]).select("a", "b", "x", "y"), run, "u long, v long")


def _sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hs) of the given nodes: hashes from the text of the row that stands for each."""
    found = small(written(rows.join(nodes, "node").select("node", F.col("doc_id").alias("d"), F.col("h").alias("e")), "copy_rows"))
    texts = docs.select("doc_id", "text").join(found, (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("e"))).select("node", utf8().alias("text"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        return {"node": batch["node"], "hs": [shingle_set(x).tobytes() for x in batch["text"]]}

    return written(by_rows(texts, run, "node long, hs binary").dropDuplicates(["node"]), "copy_sets")


def _fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints the trie self-join links, or which share one."""
    fps = written(rows.groupBy("fp").agg(F.min("node").alias("a")), "copy_prints")
    same = rows.join(fps, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    u, v = fps.toDF("u", "a"), fps.toDF("v", "b")
    return same.union(near_links(fps).join(u, "u").join(v, "v").select("a", "b"))


def _meetings(named: DataFrame) -> DataFrame:
    """(key, p, q, s, node, root): who meets in which cell (key, p, q), of keys whose nodes are not
    all connected; named: (key, node, root, n). Keys with the same nodes count once."""
    keys = named.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("n").alias("n"), F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark")
    )
    keys = keys.where("lo <> hi").groupBy("c", "n", "mark").agg(F.min("key").alias("key"))
    g = F.greatest(F.ceil(F.col("c") / SLICE), F.ceil(F.col("n") / SLICE_SHINGLES)).cast("int")
    mine = named.join(keys.select("key", g.alias("g")), "key").withColumn("s", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    mine = mine.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return mine.select("key", F.least("s", "t").alias("p"), F.greatest("s", "t").alias("q"), "s", "node", "root")


def _components(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of the nodes that are similar to another; rows: one of each node."""
    keys = written(rows.select("node", "n", F.explode("bands").alias("key")), "copy_keys")
    heads = keys.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1")
    shared = written(keys.join(heads, "key").select("key", "node", "n", "a"), "copy_shared")
    stars = shared.where("node <> a").select("a", F.col("node").alias("b"))
    pairs = written(stars.union(_fingerprint_pairs(rows)).distinct(), "copy_pairs")
    links = written(_measured(pairs, _sets(docs, rows, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())), "copy_links")
    roots = written(connected_components(links), "copy_roots")

    named = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "n")
    cells = written(_meetings(written(named, "copy_named")), "copy_cells")
    if cells.isEmpty():
        return roots
    sets = _sets(docs, rows, cells.select("node").distinct())

    def meet(cell: pa.Table) -> pa.Table:
        side, p, q = (cell[n].to_numpy() for n in ("s", "p", "q"))
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in cell["hs"]]
        one, other = side == p[0], side == q[0]
        empty = np.zeros(0, np.int64)
        u, v = cell_links(cell["root"].to_numpy(), hashes, one, other) if one.any() and other.any() else (empty, empty)
        return pa.table({"u": u, "v": v})

    more = written(cells.join(sets, "node").groupBy("key", "p", "q").applyInArrow(meet, "u long, v long").distinct(), "copy_more")
    return roots if more.isEmpty() else written(connected_components(links.union(more)), "copy_roots")


def one_per_group(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: the smallest doc_id, then text hash.

    A row is known by its doc_id and text, so rows that share a doc_id are judged apart. Texts
    without words (null, empty) are copies of each other; of rows repeated whole one stays.
    Rows with a null doc_id have no name to decide by and stay. Further columns stay.
    """
    known = docs.where("doc_id is not null")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["doc_id"], "h": batch["h"], "node": [], "fp": [], "n": [], "bands": []}
        for x in batch["text"]:
            every = shingle_hashes(x, K)
            mine = np.unique(every)
            for name, value in zip(("node", "bands"), keys_of(mine), strict=True):
                out[name].append(value)
            out["fp"].append(int.from_bytes(majority(every), "big", signed=True))
            out["n"].append(len(mine))
        return out

    marked = known.select("doc_id", F.xxhash64("text").alias("h"), utf8().alias("text"))
    rows = written(by_rows(marked, run, f"doc_id {id_type}, h long, node long, fp long, n long, bands array<long>"), "copy_marks")
    of = rows.select("doc_id", "h", "node").join(_components(known, rows.dropDuplicates(["node"])), "node", "left")
    of = written(of.select("doc_id", "h", F.coalesce("root", "node").alias("root")), "copy_groups")
    best = of.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("best"))
    gone = of.join(best, "root").where(F.struct("doc_id", "h") != F.col("best")).select(F.col("doc_id").alias("d"), F.col("h").alias("e"))
    gone = small(written(gone.distinct(), "copy_gone"))
    mine = (docs["doc_id"] == gone["d"]) & (F.xxhash64(docs["text"]) == gone["e"])
    kept = docs.join(gone, mine, "left_anti")
    twice = written(of.groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("d"), F.col("h").alias("e")), "copy_twice")
    if twice.isEmpty():
        return kept
    on = kept["doc_id"].eqNullSafe(twice["d"]) & (F.xxhash64(kept["text"]) == twice["e"])
    once = kept.join(twice, on, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, on, "left_anti").unionByName(once).select(*docs.columns)
