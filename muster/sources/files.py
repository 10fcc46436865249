"""Folders of whatever file system a path names, as Spark's own readers see it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    system, where = _system(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _system(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that this package has written, if it is there."""
    system, where = _system(spark, path)
    system.delete(where, True)
