"""Defaults, validation, resource requests and health reports, row by row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.sources.schemas import GATING_ROLES

# Defaults of the cluster and application tables.
DEFAULT_REPLICAS = 1
DEFAULT_IMAGE = "apache/hadoop:3"
DEFAULT_HBASE_IMAGE = "harisekhon/hbase"
DEFAULT_RETAIN_SECONDS = 604800
# Fixed value: memory requests are counted in decimal megabytes.
MEGABYTE = 1_000_000
# Fixed value: the line of a storage report that carries the live-node count.
LIVE_NODES = r"Live datanodes \((\d+)\):"


def default_replicas(replicas: Column, default: int = DEFAULT_REPLICAS) -> Column:
    return F.coalesce(replicas, F.lit(default))


def default_image(image: Column, default: str = DEFAULT_IMAGE) -> Column:
    return F.coalesce(F.nullif(image, F.lit("")), F.lit(default))


def default_retention(
    aggregate: Column, seconds: Column, default: int = DEFAULT_RETAIN_SECONDS
) -> Column:
    """``default`` where log aggregation is on and no positive retention is set."""
    unset = F.coalesce(seconds, F.lit(0)) <= 0
    return F.when(F.coalesce(aggregate, F.lit(False)) & unset, F.lit(default)).otherwise(seconds)


def default_images(containers: Column, default: str = DEFAULT_IMAGE) -> Column:
    """An array of structs, each without an image given the default one."""
    return F.transform(containers, lambda c: c.withField("image", default_image(c["image"], default)))


def _filled(frame: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Sets columns and, by dotted paths, fields of structs; a null struct stays null."""
    columns: dict[str, Column] = {}
    for path, value in values.items():
        column, _, field = path.partition(".")
        whole = columns.get(column, F.col(column))
        columns[column] = whole.withField(field, value) if field else value
    return frame.withColumns(columns)


def _present(frame: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Gives the structs at these paths, where null, fields that are all null."""
    types = frame.select(*[F.col(p).alias(str(i)) for i, p in enumerate(paths)]).schema
    empty = {p: F.from_json(F.lit("{}"), t.dataType) for p, t in zip(paths, types)}
    return _filled(frame, {p: F.coalesce(F.col(p), e) for p, e in empty.items()})


def apply_defaults(
    specs: DataFrame,
    replicas: Sequence[str] = (),
    images: Mapping[str, str] | None = None,
    retention: Mapping[str, str] | None = None,
    containers: Mapping[str, str] | None = None,
) -> DataFrame:
    """Fills the named replica columns, image columns (column -> default), retention
    columns (column -> its log-aggregation flag) and the images within lists of containers
    (column -> default). Names may be dotted paths into structs; what lies in a null struct
    stays null."""
    return _filled(
        specs,
        {
            **{c: default_replicas(F.col(c)) for c in replicas},
            **{c: default_image(F.col(c), d) for c, d in (images or {}).items()},
            **{
                c: default_retention(F.col(flag), F.col(c))
                for c, flag in (retention or {}).items()
            },
            **{c: default_images(F.col(c), d) for c, d in (containers or {}).items()},
        },
    )


def default_clusters(clusters: DataFrame) -> DataFrame:
    """The clusters table of :data:`muster.sources.schemas.SCHEMAS` with its defaults. A role
    that is not mentioned gets them all; the optional hbase only where it is present."""
    roles = [f"spec.{role}" for role in GATING_ROLES]
    return apply_defaults(
        _present(_present(clusters, ["spec"]), roles),
        [f"{role}.replicas" for role in roles],
        {f"{role}.image": DEFAULT_IMAGE for role in roles} | {"spec.hbase.image": DEFAULT_HBASE_IMAGE},
        {"spec.namenode.retain_seconds": "spec.namenode.log_aggregation"},
    )


def default_applications(applications: DataFrame) -> DataFrame:
    """The applications table with its defaults: those of the executor, and an image for each
    container of a data loader, where there is one."""
    return apply_defaults(
        _present(_present(applications, ["spec"]), ["spec.executor"]),
        ["spec.executor.replicas"],
        {"spec.executor.image": DEFAULT_IMAGE},
        containers={"spec.dataloader.containers": DEFAULT_IMAGE},
    )


def validate(
    specs: DataFrame,
    single: Mapping[str, str],
    images: Mapping[str, str],
    image: str = DEFAULT_IMAGE,
) -> DataFrame:
    """Adds ``error`` (null if valid) and ``warnings``.

    ``single`` maps roles that allow one replica to their replica column, in the order they
    are checked; the first violation is the error and suppresses all warnings. ``images``
    maps roles to their image column; an image other than the default is one warning.
    """
    violations = [
        F.when(
            F.col(c) > 1,
            F.concat(F.lit(f"{role} allows 1 replica, not "), F.col(c).cast("string")),
        )
        for role, c in single.items()
    ]
    error = F.coalesce(*violations, F.lit(None).cast("string"))
    foreign = F.array_compact(
        F.array(
            *[
                F.when(~F.col(c).eqNullSafe(F.lit(image)), F.lit(f"{role} runs another image"))
                for role, c in images.items()
            ]
        )
    )
    none = F.array().cast("array<string>")
    return specs.withColumns(
        {"error": error, "warnings": F.when(error.isNull(), foreign).otherwise(none)}
    )


def warning_rows(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, error, warning)``: one row per warning, one with null where there is none."""
    return validated.select(*keys, "error", F.explode_outer("warnings").alias("warning"))


def vcores(cpu: Column) -> Column:
    """A CPU request as whole cores; null unless it is whole and positive."""
    return F.when((cpu > 0) & (cpu == F.floor(cpu)), F.floor(cpu).cast("bigint"))


def memory_mb(memory: Column) -> Column:
    """A memory request in bytes as decimal megabytes; null unless positive."""
    return F.when(memory > 0, F.call_function("div", memory, F.lit(MEGABYTE)))


def request_totals(
    specs: DataFrame, by: Sequence[str], cpu: str = "cpu", memory: str = "memory"
) -> DataFrame:
    """``(*by, vcores, memory_mb, cpu_requests, memory_requests)`` over all emitted requests."""
    requests = specs.select(
        *by, vcores(F.col(cpu)).alias("_cores"), memory_mb(F.col(memory)).alias("_mb")
    )
    return requests.groupBy(*by).agg(
        F.coalesce(F.sum("_cores"), F.lit(0)).alias("vcores"),
        F.coalesce(F.sum("_mb"), F.lit(0)).alias("memory_mb"),
        F.count("_cores").alias("cpu_requests"),
        F.count("_mb").alias("memory_requests"),
    )


def live_nodes(report: Column) -> Column:
    """The live-node count of a report text, null when it has none."""
    return F.nullif(F.regexp_extract(report, LIVE_NODES, 1), F.lit("")).cast("bigint")


def storage_ready(report: Column) -> Column:
    """Whether a report counts at least one live node."""
    return F.coalesce(live_nodes(report) > 0, F.lit(False))
