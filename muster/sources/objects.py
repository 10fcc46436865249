"""Listing and keyed lookup of fleet objects."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.labels import matches


def list_objects(
    objects: DataFrame,
    namespace: str | None = None,
    selector: Mapping[str, str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Objects of a namespace (all if None) whose labels contain every selector pair and
    that pass the extra predicate. Plain filters, so they reach the scan."""
    if namespace is not None:
        objects = objects.where(F.col("namespace") == namespace)
    if selector:
        objects = objects.where(matches(F.col("labels"), selector))
    return objects if where is None else objects.where(where)


def get_object(objects: DataFrame, namespace: str, name: str) -> DataFrame:
    """The object of that namespace and name, or no row."""
    return objects.where((F.col("namespace") == namespace) & (F.col("name") == name))
