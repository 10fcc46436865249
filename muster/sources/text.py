"""Text scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All lines of all input paths as one table: ``value STRING``, one row per line."""
    return spark.read.text([paths] if isinstance(paths, str) else list(paths))
