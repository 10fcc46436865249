"""Streams whose rows count once, and tables kept from streams or written where they differ."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from muster.functions.labels import entries
from muster.streaming.feed import for_each_batch
from muster.streaming.keyed import BUCKET, GONE, KeyedTable


def _same(keys: Sequence[str], left: str = "", right: str = "_") -> list[Column]:
    return [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in keys]


def _touched(rows: DataFrame, table: KeyedTable) -> list[int]:
    """The buckets that rows lie in: at most the table's."""
    return [r[0] for r in rows.select(table.bucket().alias(BUCKET)).distinct().collect()]


def write_once(
    stream: DataFrame,
    keys: Sequence[str],
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    buckets: int = 16,
    every: int = 16,
) -> StreamingQuery:
    """Writes each micro-batch's rows whose ``keys`` have never come before, after ``transform``,
    under ``path/rows/batch=<id>``.

    Replays are found however long ago their first copy came, and no row is lost for being
    late: the keys seen are a table (``path/seen``), of which a batch reads the buckets that it
    touches. Of rows with equal keys in one batch any one counts. Null is a key like another.
    """
    seen = KeyedTable(f"{path}/seen", tuple(keys), buckets, every)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(list(keys))
        known = seen.read(spark, number, _touched(rows, seen))
        if known is not None:
            known = known.select(*[F.col(k).alias(f"_{k}") for k in keys])
            rows = rows.join(known, _same(keys), "left_anti")
        # Written before their keys are: a crash in between repeats both.
        rows.write.mode("overwrite").parquet(f"{path}/new/batch={number}")
        rows = spark.read.schema(batch.schema).parquet(f"{path}/new/batch={number}")
        out = transform(rows) if transform else rows
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        seen.write(rows.select(*keys), number)
        seen.compact(spark, number)

    return for_each_batch(stream, checkpoint, write)


def _comparable(rows: DataFrame, names: Sequence[str]) -> list[Column]:
    """Columns that ``<=>`` accepts: a map by its sorted entries."""
    is_map = {f.name: isinstance(f.dataType, T.MapType) for f in rows.schema}
    return [entries(F.col(c)).alias(c) if is_map[c] else F.col(c) for c in names]


def write_differing(table: KeyedTable, rows: DataFrame, number: int) -> int:
    """Writes those of the rows, unique by the table's keys, that differ from what it holds,
    as its version ``number``, and returns how many there are.

    Null equals null, and maps are compared by their entries. A repeated write finds nothing
    to do. The version counts as a whole once it has been committed; until then, and after a
    crash, readers find the one before. Columns of the table that rows lack are kept as they are
    only in rows that don't differ.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in table.keys]
    held = table.read(spark, number, _touched(rows, table))
    if held is not None:
        held = held.select(
            *[F.col(k).alias(f"_{k}") for k in table.keys], F.struct(*_comparable(held, names)).alias("_held")
        )
        met = rows.join(held, _same(table.keys), "left")
        rows = met.where(~F.struct(*_comparable(rows, names)).eqNullSafe(F.col("_held"))).select(*rows.columns)
    table.write(rows, number)
    table.compact(spark, number)
    return spark.read.parquet(f"{table.path}/delta/batch={number}").count() if table.has_rows(spark, "delta", number) else 0


def keep_counts(
    changes: DataFrame,
    keys: Mapping[str, tuple[Column, Column]],
    counts: tuple[Column, Column],
    path: str,
    checkpoint: str,
    buckets: int = 16,
    every: int = 16,
) -> StreamingQuery:
    """Keeps ``(*keys, n)`` under ``path`` from a feed whose rows carry an object before and after.

    ``keys`` gives for each key its columns of the object before and after the change (an owner,
    a role), ``counts`` how much the object counts there, before and after: 1 or 0, null for
    0, so also for an object not there before or after. A change takes from the former key what
    the object counted and adds to the latter what it counts: objects that are created, deleted,
    change their state or move to another owner are all one rule. Sums by key leave a task
    before they are shuffled. A change must come once; see :func:`write_once`.
    """
    names = list(keys)
    table = KeyedTable(path, tuple(names), buckets, every)

    def side(i: int, sign: int) -> Column:
        fields = [keys[k][i].alias(k) for k in names]
        return F.struct(*fields, (F.coalesce(counts[i], F.lit(0)).cast("long") * sign).alias("n"))

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        moves = batch.select(F.explode(F.array(side(0, -1), side(1, 1))).alias("_m")).select("_m.*")
        sums = moves.where("n <> 0").groupBy(*names).agg(F.sum("n").alias("n")).where("n <> 0")
        held = table.read(spark, number)
        if held is not None:
            held = held.select(*[F.col(k).alias(f"_{k}") for k in names], F.col("n").alias("_n"))
            sums = sums.join(held, _same(names), "left")
            sums = sums.select(*names, (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        table.write(sums.withColumn(GONE, F.col("n") == 0), number)
        table.compact(spark, number)

    return for_each_batch(changes, checkpoint, merge)
