"""Condition lists kept up to date from a stream of reports that come in any order.

Each micro-batch is reduced to one summary per object by the batch operator, which slices hot
logs, and merged into a table of one row per object by built-in functions. That is right
only where all of an object's earlier reports came before the batch's; so state and
summaries hold the places of their last and first report, void ones too, and objects with
a report that came late are folded anew from the log of their reports, which the stream
writes as it reads. The lists are thus those of the batch operator, however the reports
are cut into batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from muster.functions.conditions import CLUSTER_TYPES
from muster.operators.timeline import listed, report_summaries
from muster.plans.slices import MIN_ROWS
from muster.sources import files
from muster.streaming.feed import for_each_batch
from muster.streaming.keyed import BUCKET, KeyedTable


def _table(path: str, keys: Sequence[str], buckets: int = 16, every: int = 16) -> KeyedTable:
    return KeyedTable(f"{path}/state", tuple(keys), buckets, every)


def continued_entries(old: Column, new: Column) -> Column:
    """Entries of a log from those of its parts, every report of ``old`` being before ``new``.

    Of the new part only its first report depends on the old one: it is void if the type that
    was True last comes again with the same reason, and starts nothing if the type comes
    again at all. What follows is as the new part has it.
    """
    current = F.try_element_at(old, F.lit(-1))
    again = lambda e: F.coalesce(current["type"] == e["type"], F.lit(False))
    void = lambda e: e["only_first"] & again(e) & current["reason"].eqNullSafe(e["reason"])
    taken = F.transform(
        F.filter(new, lambda e: ~void(e)),
        lambda e: e.withField("since", F.when(e["from_first"] & again(e), current["since"]).otherwise(e["since"])),
    )
    kept = F.filter(old, lambda o: ~F.exists(taken, lambda e: e["type"] == o["type"]))
    return F.concat(kept, taken)


def maintain_conditions(
    reports: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    path: str,
    checkpoint: str,
    types: Sequence[str] = CLUSTER_TYPES,
    type_: str = "type",
    reason: str = "reason",
    message: str | None = None,
    min_rows: int = MIN_ROWS,
    buckets: int = 16,
    every: int = 16,
) -> StreamingQuery:
    """Starts a query that works off what is there and keeps the state of
    :func:`current_conditions` under ``path``.

    ``order`` is a TIMESTAMP and an id, unique within an object; a report that comes twice
    counts once. Reports may come in any order: a late one costs a new fold of its object's
    log, read from the buckets of such objects only. One row per object is state; every
    report is kept in the log.
    """
    table, log = _table(path, keys, buckets, every), f"{path}/log"
    columns = list(dict.fromkeys([*keys, *order, type_, reason, *([message] if message else [])]))

    def summaries(rows: DataFrame) -> DataFrame:
        return report_summaries(
            rows, keys, order, types, type_, reason, message, continued=True, min_rows=min_rows
        )

    def merge(batch: DataFrame, number: int) -> None:
        spark, work = batch.sparkSession, f"{path}/work-{number}"
        rows = batch.select(*columns).withColumn(BUCKET, table.bucket())
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{log}/batch={number}")
        rows = spark.read.schema(rows.schema).parquet(f"{log}/batch={number}")
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]
        if not touched:
            return
        state = table.read(spark, number, touched)
        fresh = summaries(rows.drop(BUCKET))
        if state is None:
            table.write(fresh.drop("first"), number)
            return
        state = state.select(*[F.col(c).alias(f"_{c}") for c in state.columns])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        met = fresh.join(state, same, "left").select(
            *keys,
            "last",
            F.when(F.col("_last").isNull(), F.col("entries"))
            .otherwise(continued_entries(F.col("_entries"), F.col("entries")))
            .alias("entries"),
            F.coalesce(F.col("first") <= F.col("_last"), F.lit(False)).alias("_late"),
        )
        # Written once; read to see what is late, and to write the rest.
        met.write.mode("overwrite").parquet(f"{work}/met")
        met = spark.read.schema(met.schema).parquet(f"{work}/met")
        late = met.where("_late").select(*keys, table.bucket().alias(BUCKET))
        behind = [r[0] for r in late.select(BUCKET).distinct().collect()]
        changed = met.where("not _late").drop("_late")
        if behind:
            history = spark.read.schema(f"{_ddl(rows)}, batch BIGINT").parquet(log)
            history = history.where((F.col("batch") <= number) & F.col(BUCKET).isin(*behind)).drop("batch")
            late = late.select(*[F.col(k).alias(f"_{k}") for k in keys])
            history = history.join(late, same, "left_semi").drop(BUCKET)
            history.write.mode("overwrite").parquet(f"{work}/history")
            history = spark.read.schema(history.schema).parquet(f"{work}/history")
            changed = changed.unionByName(summaries(history).drop("first"))
        table.write(changed, number)
        table.compact(spark, number)
        files.remove(spark, work)

    return for_each_batch(reports, checkpoint, merge)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def current_conditions(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    reconfiguring: str | None = "Reconfiguring",
    running: str = "Running",
) -> DataFrame:
    """``(*keys, conditions)``: the list of every object reported so far, as
    :func:`muster.operators.timeline.condition_lists` gives for all reports at once. Before the
    first report there is no table, which is an error."""
    state = _table(path, keys).read(spark)
    if state is None:
        raise ValueError(f"no report has been read into {path}")
    return listed(state, keys, reconfiguring, running)
