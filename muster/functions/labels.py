"""Selectors over, and merging of, string maps."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(labels: Column, selector: Mapping[str, str]) -> Column:
    """True where ``labels`` contains every pair of ``selector``; the empty selector takes
    all. Null, not false, where a label is missing: so a filter on it can reach the scan."""
    pairs = [labels[k] == v for k, v in selector.items()]
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def merge(destination: Column, source: Column) -> Column:
    """``destination`` with the entries of ``source`` written over it. Unchanged when either
    side is null."""
    kept = F.map_filter(destination, lambda k, _: ~F.map_contains_key(source, k))
    return F.when(
        destination.isNotNull() & source.isNotNull(), F.map_concat(kept, source)
    ).otherwise(destination)


def entries(labels: Column) -> Column:
    """A comparable form of a map: its entries in key order."""
    return F.array_sort(F.map_entries(labels))
