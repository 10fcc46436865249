"""Replica counts, readiness, stage gates, drift and missing children."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_counters(
    owners: DataFrame,
    objects: DataFrame,
    on: Sequence[str],
    counters: Mapping[str, str],
    role: str,
    phase: str,
    conditions: str,
    deleted_at: str,
) -> DataFrame:
    """``owners`` with the active objects of each role in the column that counters names."""
    counted = (
        objects.where(
            (F.col(phase) == "Running")
            & F.col(deleted_at).isNull()
            & F.col(role).isin(*counters)
        )
        .select(*on, F.col(role).alias("_role"), F.explode(conditions).alias("_condition"))
        .where((F.col("_condition.type") == "Ready") & (F.col("_condition.status") == "True"))
        .groupBy(*on)
        .agg(*[F.count_if(F.col("_role") == r).alias(c) for r, c in counters.items()])
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in counters.values()}
    return owners.join(counted, list(on), "left").withColumns(zero)


def active_units(phase: Column, conditions: Column, deleted_at: Column) -> Column:
    """What one object adds to its owner's count: 1 per Ready=True condition while it is
    Running and not being deleted, else 0."""
    ready = F.filter(conditions, lambda c: (c["type"] == "Ready") & (c["status"] == "True"))
    counts = (phase == "Running") & deleted_at.isNull() & conditions.isNotNull()
    return F.when(counts, F.size(ready)).otherwise(0)


def active_replicas(
    owners: DataFrame,
    objects: DataFrame,
    on: Sequence[str],
    roles: Sequence[str],
    role: str = "role",
    phase: str = "phase",
    conditions: str = "conditions",
    deleted_at: str = "deleted_at",
) -> DataFrame:
    """``(*owner columns, role, active)`` for every owner and every role, zero included.

    A Running object that is not being deleted adds one per Ready=True condition. One
    counter per role and owner is summed before the shuffle, so the shuffle carries one
    row per owner and map task however many objects an owner has; the join adds none when
    both sides are partitioned by the owner. ``owners`` is unique under ``on``.
    """
    counters = {r: f"_active_{i}" for i, r in enumerate(roles)}
    counted = _with_counters(owners, objects, on, counters, role, phase, conditions, deleted_at)
    per_role = F.array(
        *[F.struct(F.lit(r).alias("role"), F.col(c).alias("active")) for r, c in counters.items()]
    )
    return counted.select(*owners.columns, F.inline(per_role))


def replica_status(
    owners: DataFrame,
    objects: DataFrame,
    on: Sequence[str],
    expected: Mapping[str, str],
    role: str = "role",
    phase: str = "phase",
    conditions: str = "conditions",
    deleted_at: str = "deleted_at",
) -> DataFrame:
    """``(*owner columns, replicas)``: per role of ``expected`` (role -> the owner column or
    struct path that asks for replicas) the active and the expected number, as a MAP from
    role to STRUCT<active, expect>. Counted like :func:`active_replicas`; no further shuffle."""
    counters = {r: f"_active_{i}" for i, r in enumerate(expected)}
    counted = _with_counters(owners, objects, on, counters, role, phase, conditions, deleted_at)
    entries = [
        part
        for r, wanted in expected.items()
        for part in (
            F.lit(r),
            F.struct(
                F.col(counters[r]).cast("int").alias("active"),
                F.col(wanted).cast("int").alias("expect"),
            ),
        )
    ]
    return counted.select(*owners.columns, F.create_map(*entries).alias("replicas"))


def replica_ready(active: Column, replicas: Column, default: int = 1) -> Column:
    """A role is ready with as many active replicas as asked for (``default`` if null)."""
    return active >= F.coalesce(replicas, F.lit(default))


def cluster_readiness(
    role_status: DataFrame,
    keys: Sequence[str],
    gating_roles: Sequence[str],
    configured: DataFrame | None = None,
    role: str = "role",
    ready: str = "ready",
) -> DataFrame:
    """``(*keys, replicas_ready, configured, ready)`` per cluster.

    Every gating role must be present and ready; other roles never gate. A role that has
    several rows is ready if all of them are; a null ``ready`` is not. ``configured`` holds the keys of clusters whose config object exists (None: do not ask).
    """
    fine = F.coalesce(F.col(ready), F.lit(False))
    each = [
        (F.count_if(F.col(role) == name) > 0) & (F.count_if((F.col(role) == name) & ~fine) == 0)
        for name in gating_roles
    ]
    rolled = role_status.groupBy(*keys).agg(
        reduce(lambda a, b: a & b, each, F.lit(True)).alias("replicas_ready")
    )
    if configured is None:
        rolled = rolled.withColumn("configured", F.lit(True))
    else:
        present = configured.select(*keys).distinct().withColumn("_present", F.lit(True))
        rolled = (
            rolled.join(present, list(keys), "left")
            .withColumn("configured", F.coalesce(F.col("_present"), F.lit(False)))
            .drop("_present")
        )
    return rolled.withColumn("ready", F.col("replicas_ready") & F.col("configured"))


def first_open_stage(
    stages: DataFrame, keys: Sequence[str], stage: str = "stage", done: str = "done"
) -> DataFrame:
    """``(*keys, open_stage)``: the first stage that is not done, null when all are. Nothing
    after it runs."""
    is_open = ~F.coalesce(F.col(done), F.lit(False))
    return stages.groupBy(*keys).agg(F.min(F.when(is_open, F.col(stage))).alias("open_stage"))


def open_stage(*done: Column) -> Column:
    """Row form of the gate: the 1-based position of the first flag that is not true."""
    return F.coalesce(
        *[F.when(~F.coalesce(d, F.lit(False)), F.lit(i)) for i, d in enumerate(done, 1)]
    )


def application_open_stage(
    cluster_running: Column,
    has_loader: Column,
    loader_phase: Column,
    driver_present: Column,
    cluster_deleted_at: Column | None = None,
) -> Column:
    """Gate of an application: cluster running, data loaded (if it has a loader), driver. A
    cluster that is being deleted doesn't count as running."""
    if cluster_deleted_at is not None:
        cluster_running = cluster_running & cluster_deleted_at.isNull()
    loaded = ~has_loader | F.coalesce(loader_phase == "Succeeded", F.lit(False))
    return open_stage(cluster_running, loaded, driver_present)


def drift(
    desired: DataFrame,
    observed: DataFrame,
    keys: Sequence[str],
    desired_replicas: str = "replicas",
    observed_replicas: str = "observed",
    default: int = 1,
) -> DataFrame:
    """``(*keys, desired, observed, drifted)``: replicas differ after null means ``default``
    on both sides. Keys without an observed row have nothing to drift and are left out;
    they are the business of :func:`missing_children`."""
    want = F.coalesce(F.col(desired_replicas), F.lit(default))
    have = F.coalesce(F.col(observed_replicas), F.lit(default))
    left = desired.select(*keys, want.cast("bigint").alias("desired"))
    right = observed.select(*keys, have.cast("bigint").alias("observed"))
    return left.join(right, list(keys), "inner").withColumn(
        "drifted", F.col("desired") != F.col("observed")
    )


#: Ordinals that one row is expanded into.
ORDINALS = 10_000


def expected_children(
    parents: DataFrame, keys: Sequence[str], replicas: str = "replicas"
) -> DataFrame:
    """``(*keys, ordinal)`` for 0 .. replicas-1; null or zero replicas expect none.

    Parents are expanded in two steps, ``ORDINALS`` at a time: the ranges are dealt to the
    tasks before they are filled, so a parent of very many replicas is several tasks' work.
    """
    # A number of partitions that is given is not merged again, as these rows are few and short.
    tasks = int(parents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.expr(f"sequence(0L, bigint(`{replicas}`) - 1, {ORDINALS}L)")
    last = F.least(F.col("_first") + (ORDINALS - 1), F.col("_replicas") - 1)
    ranges = parents.where(F.col(replicas) > 0).select(
        *keys, F.col(replicas).cast("bigint").alias("_replicas"), F.explode(first).alias("_first")
    )
    kind = parents.schema[replicas].dataType
    return (
        ranges.repartition(tasks, *keys, "_first")
        .select(*keys, F.explode(F.sequence("_first", last)).alias("ordinal"))
        .withColumn("ordinal", F.col("ordinal").cast(kind))
    )


def missing_children(
    parents: DataFrame,
    children: DataFrame,
    keys: Sequence[str],
    replicas: str = "replicas",
    ordinal: str = "ordinal",
) -> DataFrame:
    """``(*keys, ordinal)`` expected but not there.

    The join key includes the ordinal, which spreads a parent with very many children.
    """
    present = children.select(*keys, F.col(ordinal).alias("ordinal")).distinct()
    return expected_children(parents, keys, replicas).join(
        present, [*keys, "ordinal"], "left_anti"
    )


def child_name(parent: Column, role: Column, ordinal: Column) -> Column:
    """The name of a numbered child: parent, role and ordinal joined by dashes."""
    return F.concat_ws("-", parent, role, ordinal.cast("string"))
