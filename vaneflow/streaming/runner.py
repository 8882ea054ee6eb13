"""Running bounded replays of streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(df: DataFrame, path: str, checkpoint: str, partitions: Sequence[str] = (), fmt: str = "parquet", mode: str = "append") -> None:
    """Process everything that is available, then stop.  Restarting with the same checkpoint goes on from there."""
    writer = df.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.trigger(availableNow=True).start().awaitTermination()


def drain_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is available batch by batch.  `handle` must be idempotent per batch id."""
    df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on local disk with checkpointed change logs instead of on the heap."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_slices(df: DataFrame, path: str, ts: str, bounds: Sequence[str]) -> None:
    """Write a table as consecutive time slices, so that a file stream sees them in order."""
    edges = [None, *bounds, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col(ts) >= F.lit(lo).cast("timestamp"))
        if hi is not None:
            part = part.filter(F.col(ts) < F.lit(hi).cast("timestamp"))
        part.write.mode("append").parquet(path)
