"""Predicates over ``ARRAY<STRUCT<type, status, ...>>`` condition lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The condition types of clusters and of applications.
CLUSTER_TYPES = ("Created", "Running", "Reconfiguring")
APPLICATION_TYPES = ("Created", "DataLoading", "Submitted", "Running", "Succeeded", "Failed")


def holds(conditions: Column, *types: str) -> Column:
    """Whether a condition of one of ``types`` is True; a null list holds nothing."""
    return F.coalesce(
        F.exists(conditions, lambda c: c["type"].isin(*types) & (c["status"] == "True")),
        F.lit(False),
    )


def is_created(conditions: Column) -> Column:
    return holds(conditions, "Created")


def is_submitted(conditions: Column) -> Column:
    return holds(conditions, "Submitted")


def is_running(conditions: Column) -> Column:
    return holds(conditions, "Running")


def is_finished(conditions: Column) -> Column:
    return holds(conditions, "Succeeded", "Failed")


def current_type(conditions: Column) -> Column:
    """The type of the last condition, null for an empty or null list."""
    return F.try_element_at(conditions, F.lit(-1))["type"]


def age_seconds(since: Column, as_of: Column) -> Column:
    """Whole seconds from ``since`` to ``as_of``."""
    return F.timestamp_diff("SECOND", since, as_of)
