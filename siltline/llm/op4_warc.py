"""WARC revisit resolution: archives that hold each payload once.

Headers alone, each with its file and row, are shuffled by payload digest to find each payload's
first page. Revisit records hold no payload, so they are made from the joined headers. Payloads are
only read again by the responses: a scan that skips the rows set in bitmaps of the revisits, which
are sent to the tasks a bounded number at a time, each time with the files that they are of. So no
payload is ever shuffled, however many revisits there are. The archives are written with fresh
headers as plain WARC files by Spark's own writer, so any file system that Spark writes will do.
Reading back parses records by their Content-Length and checks the digests.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batched, by_rows, discard, fresh_path, table, tidy, utf8, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that an archive file should have, and those that it never exceeds by more than a record.
ARCHIVE_BYTES, MOST_BYTES = 16 << 20, 1 << 30
#: Bitmaps of revisits (4 KB, for 32,768 rows of a file) that are sent to the tasks at a time.
SENT_BITMAPS = 16_384
URN = "urn:page:"
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> str:
    """A header value: control characters would end the line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value or "")


def warc_record(page_id: object, url: str | None, size: int, digest: str, payload: bytes | None, first: object, first_url: str | None, date: str) -> bytes:
    """A response record of payload, or without payload a revisit record of the page first."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{first}>", f"WARC-Refers-To-Target-URI: {_clean(first_url)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; record ends are found by Content-Length alone."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        at = start + int(head["content-length"])
        yield head, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record does not end at byte {at}")
        at += 4


def _placed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload of each row and where it is stored: file and row."""
    at = pages.metadataColumn("_metadata")
    return pages.select("page_id", "url", utf8("html").alias("payload"), at["file_path"].alias("file"), at["row_index"].alias("row"))


def _bitmaps(places: DataFrame) -> DataFrame:
    """(in_file, block, bits): the rows (file, row) as a bitmap for every 32,768 rows of a file."""
    block, bit = F.bitmap_bucket_number(F.col("row") + 1), F.bitmap_bit_position(F.col("row") + 1)
    return places.groupBy(F.col("file").alias("in_file"), block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def _rounds(headers: DataFrame, bitmaps: DataFrame) -> list[tuple[str, str] | None]:
    """Ranges (first, last) of file names with at most SENT_BITMAPS bitmaps each, or one file; None
    means all files. The driver gets a row for each file, as it does to plan any scan."""
    if bitmaps.count() <= SENT_BITMAPS:
        return [None]
    counts = bitmaps.groupBy("in_file").agg(F.count("*").alias("n"))
    files = headers.select("file").distinct().join(counts, F.col("file") == F.col("in_file"), "left")
    out, sent = [], 0
    for file, n in sorted((r.file, r.n or 0) for r in files.select("file", "n").collect()):
        if out and sent + n <= SENT_BITMAPS:
            out[-1], sent = (out[-1][0], file), sent + n
        else:
            out, sent = [*out, (file, file)], n
    return out


def unmarked(src: DataFrame, bitmaps: DataFrame, files: tuple[str, str] | None) -> DataFrame:
    """The rows of src, a result of _placed, in a range of files, that no bitmap marks: a scan that drops rows."""
    bit = F.bitmap_bit_position(F.col("row") + 1)
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    if files:
        src, bitmaps = src.where(F.col("file").between(*files)), bitmaps.where(F.col("in_file").between(*files))
    marked = (F.col("file") == F.col("in_file")) & (F.bitmap_bucket_number(F.col("row") + 1) == F.col("block"))
    return src.join(F.broadcast(bitmaps), marked & (F.getbit(byte, (bit % 8).cast("int")) == 1), "left_anti")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE, stored: bool = False) -> None:
    """Writes a record for every row of pages (page_id, url, html) to WARC files under path.

    Of rows with equal payloads of at least min_bytes the smallest page_id is the response and
    the others revisit it; rows that repeat that smallest page_id are responses as well, a null
    page_id is never the smallest, and a payload that only null ids have is always a response.
    stored: pages is a Parquet table as it was read, filtered at most, so that a row is known by
    its file and place; other pages are written once to the shared folder.
    """
    batched(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    if not stored:
        pages = written(pages.select("page_id", "url", "html"), "pages")
    src = _placed(pages)

    def heads(b: dict[str, list]) -> dict[str, list]:
        return b | {"digest": [payload_digest(x) for x in b["payload"]], "size": [len(x) for x in b["payload"]]}

    headers = written(by_rows(src, heads, f"page_id {kind}, url string, digest string, size long, file string, row long"), "headers")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = headers.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.where("n > 1 and first is not null").select("digest", "first"), "firsts")
    again = headers.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    again = again.select("page_id", "url", "size", "digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "file", "row")
    again = written(again, "revisits")
    bitmaps = written(_bitmaps(again), "revisit_rows")

    def records(b: dict[str, list]) -> dict[str, list]:
        cols = (b.get(n) or [None] * len(b["page_id"]) for n in ("page_id", "url", "size", "digest", "payload", "first_id", "first_url"))
        return {"record": [warc_record(*row, date) for row in zip(*cols, strict=True)]}

    def response(b: dict[str, list]) -> dict[str, list]:
        return records(heads(b))

    stats = headers.agg(F.avg("size").alias("mean"), F.max("size").alias("most")).first()
    per_file = max(1, min(int(ARCHIVE_BYTES // ((stats["mean"] or 0) + 600)), int(MOST_BYTES // ((stats["most"] or 0) + 600))))
    revisits = by_rows(again, records, "record binary")
    for i, files in enumerate(_rounds(headers, bitmaps)):
        out = by_rows(unmarked(src, bitmaps, files).select("page_id", "url", "payload"), response, "record binary")
        out = out.union(revisits) if i == 0 else out
        to = out.select(F.col("record").cast("string")).write.mode("append").option("lineSep", "\r\n\r\n")
        to.option("maxRecordsPerFile", per_file).text(path)
    if not stored:
        discard(pages)


def read_archives(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record under path.

    Digests of responses are computed from the stored payload and must equal their header's.
    """
    batched(spark)
    ddl = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    schema = arrow_schema(ddl)

    def one(head: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        name = lambda key: head[key][1 + len(URN) : -1] if key in head else None
        if head["warc-type"] == "response" and (payload_digest(payload) != digest or len(payload) != size):
            raise ValueError(f"payload of {head['warc-record-id']} is damaged")
        return name("warc-record-id") or None, size, digest, head["warc-type"], name("warc-refers-to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                cols = list(zip(*(one(*r) for r in parse_warc(data.as_py())), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    got = files.mapInArrow(tidy(run), ddl)
    return got.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), fresh_path(spark, "warc")
    write_archives(pages, path, stored=True)
    return read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((CAST('0x' || substr(h, CAST(1 + i // 4 * 5 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
 CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to FROM h
"""
