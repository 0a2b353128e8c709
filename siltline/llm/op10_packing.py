"""Hierarchical best-fit packing of tokenized documents into sequences of bounded length.

Each partition packs its own pieces best-fit in falling length. Nearly full bins are final;
underfull bins become items themselves and are dealt to fewer tasks for another best-fit
round, until one task is left or rounds stop helping. A task never takes more than CAP items,
so bins that nothing can fill do not pile up in one task. Membership is kept as a map from a
partition's bin to its final sequence and shift, never as lists.
"""

from __future__ import annotations

import json
import re
import zlib
from base64 import b64decode
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batched, table, tidy, utf8, written

LIMIT = 2048
#: Bins with at most so much room are final at once.
SLACK = 4
#: Tasks whose bins meet in one task of the next round, and the most items a task takes.
FAN_IN, CAP = 8, 200_000


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, by a byte-level BPE vocabulary.

    The rank file's encoder is the faster one, but gives up on about a million blanks in a row.
    Such a text is cut by the same pattern with an engine that needs no stack for it, and each
    part is merged by the same ranks: ids are those of the tokenizer file for every text."""

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added = added or {}
        self.bpe = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.added)
        self.part = regex.compile(pattern)
        self.mark = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def encode(self, text: str, special: bool = False) -> bytes:
        """special: the texts of added tokens become their ids, else they are text like any other."""
        try:
            ids = self.bpe.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())
        except ValueError:
            ids = np.fromiter(self.by_parts(text, special), "<u4")
        return ids.astype("<u4", copy=False).tobytes()

    def by_parts(self, text: str, special: bool) -> Iterator[int]:
        """The same ids, part by part; parts are those of the pattern between added tokens."""
        at = 0
        for m in self.mark.finditer(text) if special and self.mark else ():
            yield from self._plain(text[at : m.start()])
            yield self.added[m[0]]
            at = m.end()
        yield from self._plain(text[at:])

    def _plain(self, text: str) -> Iterator[int]:
        for m in self.part.finditer(text):
            yield from self.bpe._encode_single_piece(m[0])  # noqa: SLF001


_encoder: dict[str, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    """The worker's encoder; vocabulary is a .tiktoken file, by default the public 50k one. Its
    added tokens are those of the tokenizer file of the same name, where there is one."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoder:
        full, added = Path(path).with_suffix(".json"), {}
        if full.exists():
            added = {t["content"]: t["id"] for t in json.loads(full.read_text("utf-8"))["added_tokens"]}
        _encoder[path] = Encoder(path, public_tokenizers.PATTERN, added)
    return _encoder[path]


def best_fit(sizes: list[int], limit: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of every item and the fill of every bin, best-fit in falling size."""
    room: list[list[int]] = [[] for _ in range(limit + 1)]
    open_, where, at, fill = 0, [0] * len(sizes), [0] * len(sizes), []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        fits = open_ >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            b, r = len(fill), limit
            fill.append(0)
        where[i], at[i] = b, fill[b]
        fill[b] += size
        r -= size
        if r:
            room[r].append(b)
            open_ |= 1 << r
    return where, at, fill


def pieces(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and an end id 0, cut from its
    end into pieces of limit ids when longer, so only the first piece may be shorter."""
    batched(docs.sparkSession)
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                doc_id, ids = doc_id.as_py(), enc.encode(text.as_py(), special=True) + b"\0\0\0\0"
                n = len(ids) // 4
                cuts = [0, *range(n % limit or limit, n + 1, limit)] if n > limit else [0, n]
                rows += [(doc_id, i, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for i, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), ddl)


def _packed(df: DataFrame, size: str, limit: int, level: int, ddl: str) -> DataFrame:
    """df with bin, at and fill: a best-fit packing of each partition, in blocks of CAP rows."""
    full = f"{ddl}, bin long, at long, fill long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (level << 56) | (TaskContext.get().partitionId() << 30)
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            t = pa.Table.from_batches(held).combine_chunks()
            where, at, fill = best_fit(t[size].to_pylist(), limit)
            where = np.array(where, np.int64)
            t = t.append_column("bin", pa.array(where + base)).append_column("at", pa.array(at, pa.int64()))
            yield from t.append_column("fill", pa.array(np.array(fill, np.int64)[where])).to_batches()
            base += len(fill)
            held.clear()

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= CAP:
                yield from flush()
        if held:
            yield from flush()

    return df.mapInArrow(tidy(run), full)


def packed(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's pieces in
    sequences of at most limit tokens.

    Null and empty texts are one end token. Repeated rows are packed as often as they come; a
    null doc_id stays null; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = pieces(docs, limit, vocabulary)
    ddl = re.sub(r"^struct<|>$", "", cut.schema.simpleString()).replace(":", " ")
    cut = written(_packed(cut, "length", limit, 1, ddl), "packed")
    bins = cut.groupBy("bin").agg(F.max("fill").alias("fill"))
    live = written(bins.where(F.col("fill") < limit - SLACK).select(F.col("bin").alias("node"), "fill"), "live")
    count, tasks, level = live.count(), cut.rdd.getNumPartitions(), 1
    moved = None
    while count > 1 and level < 60:
        last = tasks == 1
        tasks = max(-(-count // CAP), -(-tasks // FAN_IN))
        level += 1
        merged = _packed(live.withColumnRenamed("fill", "size").repartition(tasks, "node"), "size", limit, level, "node long, size long")
        merged = written(merged, "merged")
        step = merged.select("node", F.col("bin").alias("root"), F.col("at").alias("shift"))
        if moved is None:
            moved = step
        else:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("new"), F.col("shift").alias("more"))
            moved = moved.join(up, "root", "left").select(
                "node", F.coalesce("new", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
        moved = written(moved, "moved")
        fills = merged.groupBy(F.col("bin").alias("node")).agg(F.max("fill").alias("fill"))
        live = written(fills.where(F.col("fill") < limit - SLACK), "live")
        before, count = count, live.count()
        if last or tasks == 1 or count > 0.98 * before and tasks <= -(-count // CAP):
            break
    if moved is None:
        return cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    final = cut.join(moved.withColumnRenamed("node", "bin"), "bin", "left")
    return final.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("root", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
