"""Layered settings: defaults, then rows for the spec fields that are set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.operators.rules import memory_mb, vcores


@dataclass(frozen=True)
class Setting:
    """A row for ``file``, emitted where ``value`` is not null."""

    file: str
    name: str
    value: Column


def spec_settings(spec: Mapping[str, Column]) -> list[Setting]:
    """The rows a cluster's spec adds. ``spec`` gives the columns ``log_aggregation,
    retain_seconds, name_dir, block_size, data_dir, cpu, memory``."""
    aggregate = F.coalesce(spec["log_aggregation"], F.lit(False))
    positive_block = F.when(spec["block_size"] > 0, spec["block_size"])
    hdfs, yarn = "hdfs-site.xml", "yarn-site.xml"
    # File and property names.
    return [
        Setting(hdfs, "dfs.namenode.log-aggregation.enable", F.when(aggregate, F.lit("true"))),
        Setting(
            hdfs,
            "dfs.namenode.log-aggregation.retain-seconds",
            F.when(aggregate, F.coalesce(spec["retain_seconds"], F.lit(0))),
        ),
        Setting(hdfs, "dfs.namenode.name.dir", F.nullif(spec["name_dir"], F.lit(""))),
        Setting(hdfs, "dfs.blocksize", positive_block),
        Setting(hdfs, "dfs.datanode.data.dir", F.nullif(spec["data_dir"], F.lit(""))),
        Setting(yarn, "yarn.nodemanager.resource.cpu-vcores", vcores(spec["cpu"])),
        Setting(yarn, "yarn.nodemanager.resource.memory-mb", memory_mb(spec["memory"])),
    ]


def layered_settings(
    clusters: DataFrame,
    keys: Sequence[str],
    defaults: Sequence[tuple[str, str, str]],
    added: Sequence[Setting],
) -> DataFrame:
    """``(*keys, position, file, name, value)``: per cluster the ``defaults`` and behind
    them the ``added`` rows that apply. Rows are appended, none is overridden.

    ``defaults`` is a short list held by the program (a file of settings), so it travels as
    a literal and each cluster is expanded where it is read: no join, no shuffle.
    """
    row = "struct<file:string,name:string,value:string>"
    base = F.array(
        *[F.struct(*[F.lit(x) for x in setting]).cast(row) for setting in defaults]
    ).cast(f"array<{row}>")
    extra = F.array(
        *[
            F.when(
                s.value.isNotNull(),
                F.struct(F.lit(s.file), F.lit(s.name), s.value.cast("string")).cast(row),
            )
            for s in added
        ]
    ).cast(f"array<{row}>")
    return clusters.select(
        *keys,
        F.posexplode(F.concat(base, F.array_compact(extra))).alias("position", "_setting"),
    ).select(*keys, "position", "_setting.*")


def sorted_settings(settings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Settings in name order within each cluster and file, equal names in layer order."""
    return settings.repartition(*keys).sortWithinPartitions(*keys, "file", "name", "position")
