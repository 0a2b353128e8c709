"""Sharding by a k-d tree over text metadata, with built-in DataFrame functions only.

A node that stands for several shards is split along the metadata dimension in which its rows
spread widest, each dimension measured on its spread over all rows, at the weighted median of row sizes (or at the fraction that its shards ask for). The
median is exact: four counting passes narrow a 63-bit sort key by 16 bits each, so a pass
returns one row per node whatever the table's size. Dimensions and tie-breakers are functions
of the text, so rows of equal texts stay together, unless such a group alone outweighs a set
share of a shard; only then its rows are told apart by a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS = 8
#: Share of a shard's bytes up to which equal texts stay together.
GROUP_SHARE = 0.5
#: Bits of a dimension, of the text hash and of the salt in a sort key; they add up to 63.
DIM_BITS, HASH_BITS, SALT_BITS = 22, 26, 15
#: Rows that one numbering bucket holds on average.
BUCKET_ROWS = 20_000


def default_dimensions() -> list[Column]:
    """Metadata of a text: log size, bytes a character, share of letters, log number of lines,
    characters a word. All are functions of the text, so equal texts have equal values."""
    text = F.coalesce("text", F.lit(""))
    chars = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    return [
        F.log2(F.col("size").cast("double")),
        (F.col("size") - 1) / chars,
        F.regexp_count(text, F.lit(r"\p{L}")) / chars,
        F.log2(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1.0),
        F.log2(chars / (F.regexp_count(text, F.lit(r"\s+")) + 1.0) + 1.0),
    ]


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(str(tuple(r)) for r in rows) + f" AS t({names})")


def _cuts(rows: DataFrame, targets: dict[int, float]) -> dict[int, tuple[int, bool]]:
    """For each node (key, whether rows at key go left) nearest to its target weight.

    rows: node, key (63 bits), size; targets: weight that should go left of the cut.
    """
    spark = rows.sparkSession
    at = {n: (0, 0.0, 0.0) for n in targets}  # prefix so far, weight below it, weight at it
    for shift in (48, 32, 16, 0):
        known = _values(spark, [(n, at[n][0], float(at[n][1]), float(targets[n])) for n in at], "node, prefix, below, target")
        part = rows.join(F.broadcast(known), "node").where(F.shiftright("key", shift + 16) == F.col("prefix")) if shift < 48 else rows.join(F.broadcast(known), "node")
        sums = part.groupBy("node", "below", "target", F.shiftright("key", shift).alias("prefix")).agg(F.sum("size").cast("double").alias("here"))
        upto = F.sum("here").over(Window.partitionBy("node").orderBy("prefix")) + F.col("below")
        reached = sums.withColumn("upto", upto).where("upto >= target").groupBy("node").agg(F.min(F.struct("prefix", "upto", "here")).alias("m"))
        at = {r.node: (r.m.prefix, r.m.upto - r.m.here, r.m.here) for r in reached.collect()}
    return {n: (k, below + here - targets[n] <= targets[n] - below) for n, (k, below, here) in at.items()}


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, dimensions: list[Column] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs (doc_id, text).

    Leaves are `shards` many, or as many as reach target_bytes. size: UTF-8 bytes plus 1 (null:
    1). slot numbers a shard's rows without gaps. Repeated rows and null ids stay; equal texts
    share a shard unless their bytes exceed GROUP_SHARE of one. Fewer rows or groups than
    shards leave some shards empty; an empty table gives an empty result. dimensions: numeric
    columns of docs' text; null counts as 0. Ties along a dimension go by the text's hash.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    base = docs.select("doc_id", "text", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dims = dimensions or default_dimensions()
    names = [f"d{i}" for i in range(len(dims))]
    raw = [F.coalesce(d.cast("double"), F.lit(0.0)).alias(n) for n, d in zip(names, dims, strict=True)]
    flat = base.select("doc_id", "size", "text_crc32", F.xxhash64("text").alias("h"), *raw, F.monotonically_increasing_id().alias("mid"))
    flat = written(flat, "flat")
    ends = [f(n).alias(f"{at}_{n}") for n in names for f, at in ((F.min, "lo"), (F.max, "hi"))]
    total = flat.agg(F.sum("size").alias("b"), F.count("*").alias("n"), *ends).first()
    if not total.n:
        return flat.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # every dimension on its own spread, so that the widest in a node is the least narrowed one
    for n in names:
        lo, wide = total[f"lo_{n}"], total[f"hi_{n}"] - total[f"lo_{n}"]
        whole = F.least((F.col(n) - lo) / wide, F.lit(1.0)) * ((1 << DIM_BITS) - 1) if wide > 0 else F.lit(0)
        flat = flat.withColumn(n, whole.cast("long"))
    leaves = shards or max(1, -(-total.b // target_bytes))
    # rows of groups that outweigh their share of a shard: at most leaves / GROUP_SHARE groups
    hot = flat.groupBy("h", F.col("size").alias("s")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    hot = written(hot.where((F.col("b") > GROUP_SHARE * total.b / leaves) & (F.col("n") > 1)).select("h", "s", F.lit(True).alias("hot")), "hot")
    flat = flat.join(F.broadcast(hot), (flat.h == hot.h) & (flat.size == hot.s), "left").select(flat["*"], "hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("mid"), F.lit(1 << SALT_BITS))).otherwise(F.lit(0).cast("long"))
    tie = F.shiftleft(F.shiftrightunsigned("h", 64 - HASH_BITS), SALT_BITS).bitwiseOR(salt)
    tree = flat.withColumn("tie", tie).withColumn("node", F.lit(0)).drop("hot")
    span = {0: (0, leaves)}  # node: its first shard and number of shards
    while True:
        tree = written(tree, "tree")
        split = {n: s for n, s in span.items() if s[1] > 1}
        if not split:
            break
        spread = [(F.max(d) - F.min(d)).alias(d) for d in names]
        wide = tree.groupBy("node").agg(F.sum("size").alias("b"), *spread).collect()
        picked = {r.node: max(names, key=lambda d, r=r: r[d]) for r in wide if r.node in split}
        targets = {r.node: r.b * (split[r.node][1] // 2) / split[r.node][1] for r in wide if r.node in split}
        if not picked:
            break
        dim = _values(spark, [(n, d) for n, d in picked.items()], "node, dim")
        value = F.coalesce(*(F.when(F.col("dim") == d, F.col(d)) for d in names))
        keyed = tree.join(F.broadcast(dim), "node", "left").withColumn("key", F.shiftleft(value, HASH_BITS + SALT_BITS).bitwiseOR(F.col("tie")))
        cuts = _cuts(keyed.where("dim is not null").select("node", "key", "size"), targets)
        new = {n: s for n, s in span.items() if s[1] == 1}
        moves = []
        for n, (first, m) in split.items():
            if n in cuts:
                new[2 * n + 1], new[2 * n + 2] = (first, m // 2), (first + m // 2, m - m // 2)
                moves.append((n, *cuts[n]))
        move = F.broadcast(_values(spark, moves, "node, cut, with_cut"))
        left = (F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & F.col("with_cut"))
        node = F.when(F.col("cut").isNull(), F.col("node")).when(left, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
        tree = keyed.join(move, "node", "left").withColumn("node", node.cast("int")).select(*tree.columns)
        span = new
    shard = _values(spark, [(n, s[0]) for n, s in span.items()], "node, shard")
    parts = max(1, total.n // (leaves * BUCKET_ROWS))
    rows = tree.join(F.broadcast(shard), "node").withColumn("bucket", F.pmod(F.xxhash64("mid"), F.lit(parts)).cast("int"))
    rows = written(rows.select("doc_id", "size", "text_crc32", "shard", "bucket", "mid"), "sharded")
    counts = rows.groupBy("shard", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset")), "offsets")
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("mid")) - 1
    out = rows.withColumn("number", number).join(offsets, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("number") + F.col("offset")).cast("long").alias("slot"))


def op9_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
