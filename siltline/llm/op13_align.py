"""Alignment of two tokenizers: merge-path pieces of both lists of token ends.

Both tokenizers cut the same bytes, so their token ends are two rising lists, and merging them
visits every overlap once. A diagonal i + j = d crosses the merge path in one place, which a
binary search finds; diagonals at equal distances thus cut a document into pieces of equal work
that know nothing of each other. A piece is a row with its ids, its ends, one token of each
side beyond its end and the end before its start: enough to emit every overlap whose bytes end
in it. Groups that a cut divides are stitched from their pieces in order.

How many documents hold a pair of ids linked is counted by Spark over the pairs of all pieces;
pairs of documents of several pieces are made distinct first. The counts meet the pieces' pairs
again by a join, for which they are sent to all tasks only where small() finds them small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batched, small, table, tidy, written
from .op10_packing import encoder

#: Token ends (of both sides) of one piece.
WIDTH = 1 << 16
#: Characters after which B's encoder is given the next part of a text.
PART = 1 << 16
BLANK = "▁"


@dataclass
class Side:
    """One tokenizer's tokens: bytes of each id, their lengths, ids as text with what may follow."""

    bytes_: list[bytes]

    def __post_init__(self) -> None:
        self.size = np.array([len(b) for b in self.bytes_], np.int64)
        self.shown = [f"{i}{after}" for after in ",|;" for i in range(len(self.bytes_))]


def picked(values: list, ids: np.ndarray) -> tuple:
    """The values at ids."""
    return itemgetter(*ids.tolist())(values) if len(ids) > 1 else tuple(values[i] for i in ids.tolist())


class Pair:
    """Both encoders of a worker."""

    def __init__(self, a_file: str | None, b_file: str | None) -> None:
        import public_tokenizers
        import sentencepiece

        self.first = encoder(a_file)
        self.a = Side([self.first.bpe.decode_single_token_bytes(i) for i in range(self.first.bpe.n_vocab - len(self.first.added))])
        self.second = sentencepiece.SentencePieceProcessor(model_file=b_file or public_tokenizers.path("piece_bpe_32k.model"))
        n = self.second.get_piece_size()
        piece = self.second.id_to_piece
        self.b = Side([bytes([int(piece(i)[1:-1], 16)]) if self.second.is_byte(i) else piece(i).replace(BLANK, " ").encode() for i in range(n)])
        # merges never pass from another character to a blank if no piece holds a blank after one
        self.cuts = not any(BLANK in piece(i).lstrip(BLANK) for i in range(n))
        self.shown = self.a.shown + self.b.shown

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where the text is empty or a side's bytes are not those of a
        blank and the text."""
        if text:
            want = b" " + text.encode()
            a = np.frombuffer(self.first.encode(" " + text), "<u4").astype(np.int32)
            b = np.array([i for part in (parts(text) if self.cuts else [text]) for i in self.second.encode(part)], np.int32)
            if all(b"".join(picked(side.bytes_, ids)) == want for side, ids in ((self.a, a), (self.b, b))):
                return a, b
        return np.zeros(0, np.int32), np.zeros(0, np.int32)


_pairs: dict[tuple, Pair] = {}


def pair(a_file: str | None = None, b_file: str | None = None) -> Pair:
    if (a_file, b_file) not in _pairs:
        _pairs[a_file, b_file] = Pair(a_file, b_file)
    return _pairs[a_file, b_file]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """text in parts of about size characters, each but the first without the blank before it,
    which the encoder puts there itself. A cut lies before a blank after another character."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1] in (" ", BLANK):
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut == len(text) - 1:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def diagonal(ea: np.ndarray, eb: np.ndarray, d: int) -> tuple[int, int]:
    """(i, j), i + j = d: how many of ea and eb are the first d ends; of equal ends ea's is first."""
    lo, hi = max(0, d - len(eb)), min(d, len(ea))
    while lo < hi:
        mid = (lo + hi) // 2
        if ea[mid] <= eb[d - mid - 1]:
            lo = mid + 1
        else:
            hi = mid
    return lo, d - lo


@dataclass
class Piece:
    """The ends of a document from one diagonal to the next: ids and ends of each side with one
    token of lookahead, how many of them end here, and A's end before (-1: none)."""

    a: np.ndarray
    ea: np.ndarray
    b: np.ndarray
    eb: np.ndarray
    na: int
    nb: int
    before: int


def pieces(a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray, width: int = WIDTH) -> Iterator[Piece]:
    """The merge path of both lists of ends in pieces of width ends; one empty piece without tokens."""
    n = len(ea) + len(eb)
    cuts = [diagonal(ea, eb, d) for d in range(0, n, width)] + [(len(ea), len(eb))]
    for (i, j), (k, m) in zip(cuts, cuts[1:] or cuts, strict=False):
        yield Piece(a[i : k + 1], ea[i : k + 1], b[j : m + 1], eb[j : m + 1], k - i, m - j, int(ea[i - 1]) if i else -1)


def overlaps(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A id, B id) of every overlap whose bytes end in the piece, and the ends of its groups."""
    ea, eb = p.ea[: p.na], p.eb[: p.nb]
    at = np.searchsorted(p.ea, eb)  # the A token around each B end
    tied = np.zeros(p.nb, bool)
    inside = at < len(p.ea)
    tied[inside] = p.ea[at[inside]] == eb[inside]
    tied |= eb == p.before
    own = ~tied  # where both end, the overlap was emitted for A's end
    left = np.concatenate([p.a[: p.na], p.a[at[own]]])
    right = np.concatenate([p.b[np.searchsorted(p.eb, ea)], p.b[: p.nb][own]])
    return left, right, eb[tied]


def shown_groups(p: Piece, cuts: np.ndarray, both: Pair) -> tuple[list[str], str, list[str]]:
    """The piece's ids as text: A's and B's up to its first group end, the groups after that one
    as "a,a|b;", and A's and B's after the last group end (ids end with commas)."""
    ga, gb = np.searchsorted(cuts, p.ea[: p.na]), np.searchsorted(cuts, p.eb[: p.nb])
    show = lambda side, ids: "".join(picked(side.shown, ids))
    a, b, n = p.a[: p.na], p.b[: p.nb], len(cuts)
    head = [show(both.a, a[ga == 0]), show(both.b, b[gb == 0])]
    tail = [show(both.a, a[ga == n]), show(both.b, b[gb == n])] if n else ["", ""]
    ma, mb = (ga > 0) & (ga < n), (gb > 0) & (gb < n)
    group = np.concatenate([ga[ma] * 2, gb[mb] * 2 + 1])
    order = np.argsort(group, kind="stable")
    group = group[order]
    step = np.diff(group, append=-1)  # 0: same side, 1 within a group: to B, else: a new group
    sep = np.where(step == 0, 0, np.where(group % 2 == 0, 1, 2))
    ids = np.concatenate([a[ma], b[mb]])[order]
    of_b = order >= ma.sum()
    width = np.where(of_b, len(both.b.bytes_), len(both.a.bytes_))
    return head, "".join(picked(both.shown, of_b * len(both.a.shown) + sep * width + ids)), tail


class Groups:
    """SHA-256 of a document's groups from its pieces in order."""

    def __init__(self) -> None:
        self.sha, self.open, self.some = hashlib.sha256(), [[], []], False

    def add(self, head: list[str], closed: bool, body: str, tail: list[str]) -> None:
        for held, ids in zip(self.open, head, strict=True):
            held.append(ids)
        if closed:
            a, b = ("".join(x)[:-1] for x in self.open)
            self.sha.update(f"{';' * self.some}{a}|{b}".encode())
            if body:
                self.sha.update(f";{body[:-1]}".encode())
            self.open, self.some = [[tail[0]], [tail[1]]], True

    def digest(self) -> str:
        return self.sha.hexdigest() if self.some else ""


def aligned(docs: DataFrame, width: int = WIDTH, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """A row for each piece of every document: row (a number of the document), doc_id, piece,
    pieces, n_a, n_b, n_groups, n_links; a, b, times: the distinct linked ids of the piece and how
    often they are linked; sha: digest of the groups where there is one piece, else null, and
    head, closed, body and tail as Groups takes them."""
    batched(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = (
        f"row long, doc_id {kind}, piece int, pieces int, n_a long, n_b long, n_groups long, n_links long, a array<int>, b array<int>, "
        "times array<int>, sha string, head array<string>, closed boolean, body string, tail array<string>"
    )
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_file, b_file)
        for batch in batches:
            out: list[tuple] = []
            for row, doc_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                a, b = both.encode(text.as_py())
                ea, eb = np.cumsum(both.a.size[a]), np.cumsum(both.b.size[b])
                count = max(1, -(-(len(a) + len(b)) // width))
                for k, p in enumerate(pieces(a, ea, b, eb, width)):
                    left, right, cuts = overlaps(p)
                    ids, times = np.unique(left.astype(np.int64) << 32 | right, return_counts=True)
                    head, body, tail = shown_groups(p, cuts, both)
                    closed, sha = len(cuts) > 0, None
                    if count == 1:
                        groups = Groups()
                        groups.add(head, closed, body, tail)
                        sha, head, body, tail = groups.digest(), None, None, None
                    own = [ids >> 32, ids & 0xFFFFFFFF, times]
                    out.append((row.as_py(), doc_id.as_py(), k, count, p.na, p.nb, len(cuts), len(left), *own, sha, head, closed, body, tail))
                    if count > 1:
                        yield _batch(out, schema)
                        out = []
            yield _batch(out, schema)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(tidy(run), ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents each pair of ids is linked, and whether that is the
    most of its A id. found: a written table of aligned() rows."""
    pairs = lambda df, *more: df.select(*more, F.explode(F.arrays_zip("a", "b")).alias("p")).select(*more, "p.a", "p.b")
    once = pairs(found.where("pieces = 1"))
    again = pairs(found.where("pieces > 1"), "row").distinct().drop("row")
    counts = once.unionByName(again).groupBy("a", "b").agg(F.count("*").alias("n"))
    # an A id meets at most B's vocabulary, so no window holds more rows than that
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def stitched(found: DataFrame) -> DataFrame:
    """(row, sha) of documents of several pieces, whose pieces are streamed in order."""
    ddl = "row long, sha string"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, groups = None, Groups()
        for b in batches:
            for row, _, head, closed, body, tail in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if now is not None and row != now:
                    yield _batch([(now, groups.digest())], schema)
                    groups = Groups()
                now = row
                groups.add(head, closed, body, tail)
        if now is not None:
            yield _batch([(now, groups.digest())], schema)

    rows = found.where("pieces > 1").select("row", "piece", "head", "closed", "body", "tail")
    return rows.repartition("row").sortWithinPartitions("row", "piece").mapInArrow(tidy(run), ddl)


def alignments(docs: DataFrame, width: int = WIDTH, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte (B reads
    U+2581 as a blank), have no tokens: zeros and an empty digest. Repeated rows are documents of
    their own and are counted each; null ids stay null; equal counts are best together; an empty
    table gives an empty result. A document is encoded and cut by one task.
    """
    found = written(aligned(docs, width, a_file, b_file), "aligned")
    counts = written(pair_counts(found), "pair_counts")
    met = found.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("row", "p.*").join(small(counts), ["a", "b"])
    zero, none = F.lit(0).cast("long"), F.lit(None)
    kind = docs.schema["doc_id"].dataType
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    totals = ["n_a", "n_b", "n_groups", "n_links"]
    blank = [zero.alias(c) for c in totals]
    every = (
        found.select("row", "doc_id", *totals, zero.alias("n_best"), zero.alias("count_sum"), "sha")
        .unionByName(sums.select("row", none.cast(kind).alias("doc_id"), *blank, "n_best", "count_sum", none.cast("string").alias("sha")))
        .unionByName(stitched(found).select("row", none.cast(kind).alias("doc_id"), *blank, zero.alias("n_best"), zero.alias("count_sum"), "sha"))
    )
    out = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in [*totals, "n_best", "count_sum"]), F.max("sha").alias("groups_sha256"))
    return out.drop("row")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
