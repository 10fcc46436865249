"""Each version of an object beside the one before it, kept from a stream in any order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from muster.plans.slices import MIN_ROWS, with_previous
from muster.sources import files
from muster.streaming.feed import for_each_batch
from muster.streaming.keyed import BUCKET, KeyedTable

#: Results are never compacted: each is written once, but for those that a late version changes.
_NEVER = 1 << 30


def _tables(path: str, keys: Sequence[str], order: Sequence[str], buckets: int, every: int) -> tuple[KeyedTable, KeyedTable]:
    last = KeyedTable(f"{path}/last", tuple(keys), buckets, every)
    return last, KeyedTable(f"{path}/versions", (*keys, *order), buckets, _NEVER)


def maintain_previous(
    versions: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    path: str,
    checkpoint: str,
    prev: str = "prev",
    min_rows: int = MIN_ROWS,
    buckets: int = 16,
    every: int = 16,
) -> StreamingQuery:
    """Keeps under ``path`` what :func:`muster.plans.slices.with_previous` gives for all versions
    that have come so far, for :func:`read_previous`.

    Within a micro-batch that function finds the version before, slicing hot objects; only
    an object's first version of the batch meets the state, a row per object with its
    last version. Objects with a version that came late, before one of an earlier batch, are
    worked out anew from the log of their versions, and their rows replaced. Versions that
    come twice count once.
    """
    keys, order = list(keys), list(order)
    carried = list(dict.fromkeys([*order, *columns]))
    last, results = _tables(path, keys, order, buckets, every)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]

    def paired(rows: DataFrame) -> DataFrame:
        return with_previous(rows, keys, order, columns, prev, min_rows)

    def merge(batch: DataFrame, number: int) -> None:
        spark, work = batch.sparkSession, f"{path}/work-{number}"
        rows = batch.dropDuplicates([*keys, *order]).withColumn(BUCKET, last.bucket())
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/log/batch={number}")
        rows = spark.read.schema(rows.schema).parquet(f"{path}/log/batch={number}")
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]
        if not touched:
            return
        rows = rows.drop(BUCKET)
        ends = rows.groupBy(*keys).agg(
            F.min(F.struct(*order)).alias("first"), F.max_by(F.struct(*carried), F.struct(*order)).alias("row")
        )
        state = last.read(spark, number, touched)
        if state is None:
            results.write(paired(rows), number)
            last.write(ends.select(*keys, "row"), number)
            return
        state = state.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("row").alias("_row"))
        place = lambda c: F.struct(*[F.col(f"{c}.{o}").alias(o) for o in order])
        met = ends.join(state, same, "left").withColumn("_late", F.coalesce(F.col("first") <= place("_row"), F.lit(False)))
        met.drop(*[f"_{k}" for k in keys]).write.mode("overwrite").parquet(f"{work}/met")
        met = spark.read.parquet(f"{work}/met")
        behind = [r[0] for r in met.where("_late").select(last.bucket()).distinct().collect()]
        ahead = F.coalesce(place("_row") > place("row"), F.lit(False))
        now = met.select(*keys, F.when(ahead, F.col("_row")).otherwise(F.col("row")).alias("row"))
        found = paired(rows)
        if behind:
            late = met.where("_late").select(*[F.col(k).alias(f"_{k}") for k in keys])
            log = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
            history = spark.read.schema(f"{log}, {BUCKET} INT, batch BIGINT").parquet(f"{path}/log")
            history = history.where((F.col("batch") <= number) & F.col(BUCKET).isin(*behind)).drop("batch", BUCKET)
            history = history.join(late, same, "left_semi").dropDuplicates([*keys, *order])
            history.write.mode("overwrite").parquet(f"{work}/history")
            again = paired(spark.read.schema(history.schema).parquet(f"{work}/history"))
            found = found.join(late, same, "left_anti")
        # Only the heads of a batch's logs meet the state: one row per object.
        heads = met.where(~F.col("_late") & F.col("_row").isNotNull())
        heads = heads.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*[F.col(f"_row.{c}").alias(c) for c in columns]).alias("_head"))
        first = found.where(F.col(prev).isNull()).join(heads, same, "left")
        first = first.withColumn(prev, F.col("_head")).select(*found.columns)
        found = found.where(F.col(prev).isNotNull()).unionByName(first)
        results.write(found.unionByName(again) if behind else found, number)
        last.write(now, number)
        last.compact(spark, number)
        files.remove(spark, work)

    return for_each_batch(versions, checkpoint, merge)


def read_previous(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All versions so far with ``prev``, the columns of the version before. An error before
    the first version has come."""
    rows = _tables(path, keys, order, 16, 16)[1].read(spark)
    if rows is None:
        raise ValueError(f"no version has been read into {path}")
    return rows
