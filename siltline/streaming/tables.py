"""Tables as streams: every file of a table is read once, results land in the shared folder.

A micro-batch writes to a folder of its own number and overwrites it when it runs again, so a
restarted query gives the same rows. The newest batch of a key is its final state.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream. The pattern names that path alone: a file source takes a
    single file only by pattern, and folders either way."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def arriving(df: DataFrame, order: str, steps: int = 4) -> tuple[DataFrame, Iterator[None]]:
    """df as a stream that comes in steps of rising order, and what brings them: each turn of it
    writes one step. A step has as many files as it has, in no order, so settled makes it one
    micro-batch before the next one comes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(path)  # so that the folder is there

    def bring() -> Iterator[None]:
        cuts = df.stat.approxQuantile(order, [i / steps for i in range(1, steps)], 0.01) if steps > 1 else []
        last = None
        for cut in [*sorted(set(cuts)), None]:
            step = df if cut is None else df.where(F.col(order) <= cut)
            (step if last is None else step.where(F.col(order) > last)).write.mode("append").parquet(path)
            last = cut
            yield

    return spark.readStream.schema(df.schema).parquet(path), bring()


@contextmanager
def state_on_disk(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """Within it, streams keep their state in RocksDB, which operators with several states need.
    idle: whether they run batches without rows; with state that lives by the clock these never end."""
    disk = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    new = {"spark.sql.streaming.stateStore.providerClass": disk, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    before = {name: spark.conf.get(name) for name in new}
    try:
        for name, value in new.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def settled(df: DataFrame, keys: list[str], mode: str = "update", arrivals: Iterable[None] = (None,)) -> DataFrame:
    """The last row of each key after df, a stream, has seen all files there are after every turn of arrivals."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    for _ in arrivals:
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.option("basePath", f"{at}/rows").schema(f"{df.schema.toDDL()}, batch int").parquet(f"{at}/rows")
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
