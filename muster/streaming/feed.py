"""Change feeds as streams: sources, replay protection and per-batch sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from muster.operators.changes import owners_to_revisit

#: State store for the streams that Spark keeps state of.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_feed(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    pattern: str | None = None,
    max_bytes: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """A folder of feed files as a stream, oldest file first: all that is there in one
    micro-batch, or at most about ``max_bytes`` (one file at least) in each."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes))
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def without_replays(
    feed: DataFrame, keys: Sequence[str], time: str, delay: str = "10 minutes"
) -> DataFrame:
    """Drops rows whose ``keys`` were seen before, as far as they are at most ``delay``
    apart in ``time`` (a TIMESTAMP). State older than the watermark is let go, and **rows
    older than the watermark are discarded**: use it only where late rows may be lost. A
    replayed micro-batch needs no such filter, since :func:`write_batches` replaces its
    folder; equal rows of different batches are made distinct on read."""
    return feed.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def write_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "update",
) -> StreamingQuery:
    """Starts a query that works off what is there and writes each micro-batch, after
    ``transform``, under ``path/batch=<id>``. A batch that is repeated after a failure
    replaces its own folder, so every change counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return for_each_batch(stream, checkpoint, write, mode)


def for_each_batch(
    stream: DataFrame,
    checkpoint: str,
    function: Callable[[DataFrame, int], None],
    mode: str = "append",
) -> StreamingQuery:
    """Starts a query that works off what is there, a micro-batch and its number at a time."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(function)
        .start()
    )


def write_owners_to_revisit(
    changes: DataFrame,
    keys: Sequence[str],
    path: str,
    checkpoint: str,
    owner: str = "new_owner",
    kind: str | None = None,
) -> StreamingQuery:
    """Per micro-batch, the distinct owners whose objects changed."""
    return write_batches(
        changes,
        path,
        checkpoint,
        lambda batch: owners_to_revisit(batch, keys, owner, kind),
        mode="append",
    )


def read_batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What :func:`write_batches` has written, with the ``batch`` number of each row."""
    return spark.read.schema(schema).parquet(path)
