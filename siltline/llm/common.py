"""Shared helpers of the training-data operators: written tables, Arrow batches, tokens.

Every operator that needs a result more than once writes it as a Parquet table under the
shared folder named by ``spark.checkpoint.dir`` and reads it back, so a lost executor costs
one task and never an inconsistent recomputation.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_dir

#: Maps A-Z to a-z and every byte outside [0-9a-z\x80-\xff] to a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds of long texts.
BATCH_ROWS, BATCH_BYTES = "1000", "4m"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and fixes its rows for later jobs."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltline_path = path  # noqa: SLF001
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by written() once nothing reads it any more."""
    path = getattr(df, "_siltline_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


#: Rows of keys (about 32 bytes each) up to which a key table is sent to every executor.
SENT_KEYS = 2_000_000


def small(keys: DataFrame) -> DataFrame:
    """keys, a written table, marked for broadcast if it has at most SENT_KEYS rows; beyond that
    Spark shuffles both sides. Rows are the same either way."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


def batched(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes for this session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(run: Callable, *memories: Callable[[], None]) -> Callable:
    """run, after whose last batch a worker gives up its memories and returns freed memory to
    the system: workers live on between tasks, beside an executor's heap."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for forget in memories:
                forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def by_rows(df: DataFrame, make: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Applies make to each Arrow batch as a dict of Python lists; a narrow, per-batch step."""
    batched(df.sparkSession)
    out = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = make({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(tidy(run), schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def utf8(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null gives no bytes."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod modulus is remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder
