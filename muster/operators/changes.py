"""Filtering and routing of change feeds; all of it works on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.functions.labels import entries

# The kinds a cluster owns, and those whose updates are looked at.
CHILD_KINDS = ("Pod", "Service", "ConfigMap", "StatefulSet")
UPDATE_KINDS = (*CHILD_KINDS, "Cluster")


def _comparable(frame: DataFrame, path: str) -> Column:
    """A column in a form ``<=>`` accepts: maps compare by their sorted entries."""
    col = F.col(path)
    is_map = isinstance(frame.select(col).schema[0].dataType, T.MapType)
    return entries(col) if is_map else col


def changed(frame: DataFrame, pairs: Mapping[str, str]) -> Column:
    """Whether any (old, new) column pair differs, null being a value of its own."""
    different = [
        ~_comparable(frame, old).eqNullSafe(_comparable(frame, new)) for old, new in pairs.items()
    ]
    return reduce(lambda a, b: a | b, different)


def changed_fields(frame: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> Column:
    """The names of the fields whose (old, new) columns differ."""
    return F.array_compact(
        F.array(*[F.when(changed(frame, {old: new}), F.lit(f)) for f, (old, new) in pairs.items()])
    )


def controller(owner: Column) -> Column:
    """``owner`` if it is the controlling one, else null."""
    return F.when(owner["controller"], owner)


def _resolvable(feed: DataFrame, owners: DataFrame, ref: str, flag: str) -> DataFrame:
    """Adds ``flag``: ``ref`` names an existing owner of that kind, namespace, name and uid.

    A left join sends all null keys to one task. Feed rows without the reference get a key
    from their resource version instead, which equals no uid and spreads them.
    """
    missing = F.concat_ws("/", F.lit("\0none"), F.col("rv_new").cast("string"))
    ref_key = F.struct(
        F.coalesce(F.col(f"{ref}.kind"), F.lit("")).alias("kind"),
        F.col("namespace").alias("namespace"),
        F.coalesce(F.col(f"{ref}.name"), F.lit("")).alias("name"),
        F.coalesce(F.col(f"{ref}.uid"), missing).alias("uid"),
    )
    key = ("kind", "namespace", "name", "uid")
    known = owners.select(*[F.col(c).alias(f"_{c}") for c in key], F.lit(True).alias(flag))
    joined = feed.join(known, [ref_key[c] == F.col(f"_{c}") for c in key], "left")
    return joined.drop(*[f"_{c}" for c in key]).withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def relevant_updates(
    feed: DataFrame, owners: DataFrame, kinds: Sequence[str] = UPDATE_KINDS
) -> DataFrame:
    """Update rows (``rv_old, rv_new, kind, namespace, name, old_owner, new_owner``) that
    call for a new look at an owner.

    Dropped are resyncs (same resource version), objects of other kinds, objects that have
    and had no controller, and those whose controller does not resolve. When the controller
    changed, the former one counts as well if it resolves and is of the same kind as the
    new one. ``owners`` is unique on ``(kind, namespace, name)``.
    """
    candidates = feed.withColumns(
        {"_old": controller(F.col("old_owner")), "_new": controller(F.col("new_owner"))}
    ).where(
        (F.col("rv_old") != F.col("rv_new"))
        & F.col("kind").isin(*kinds)
        & (F.col("_old").isNotNull() | F.col("_new").isNotNull())
    )
    moved = F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))
    same_kind = F.coalesce(F.col("_new.kind"), F.col("_old.kind")) == F.col("_old.kind")
    resolved = _resolvable(candidates, owners, "_new", "_new_ok")
    resolved = _resolvable(resolved, owners, "_old", "_old_ok")
    relevant = F.col("_new_ok") | (moved & same_kind & F.col("_old_ok"))
    return resolved.where(relevant).drop("_new", "_old", "_new_ok", "_old_ok")


def relevant_births_and_deaths(
    feed: DataFrame, kinds: Sequence[str] = CHILD_KINDS
) -> DataFrame:
    """Create and delete rows with a role label that are orphans or of a known kind. A
    created object's owner is in ``new_owner``, a deleted one's in ``old_owner``."""
    ref = F.coalesce(controller(F.col("new_owner")), controller(F.col("old_owner")))
    return feed.where(
        (F.coalesce(F.col("role"), F.lit("")) != "") & (ref.isNull() | F.col("kind").isin(*kinds))
    )


def relevant_changes(feed: DataFrame, owners: DataFrame) -> DataFrame:
    """All rows of a mixed feed (``op`` create, update or delete) that matter."""
    updates = relevant_updates(feed.where(F.col("op") == "update"), owners)
    others = relevant_births_and_deaths(feed.where(F.col("op").isin("create", "delete")))
    return updates.unionByName(others)


def owners_to_revisit(
    changes: DataFrame, keys: Sequence[str], owner: str = "new_owner", kind: str | None = None
) -> DataFrame:
    """The distinct keys of the controlling owners of changed objects.

    Duplicates leave before the shuffle, so an owner of a third of all changes is one row
    per map task. ``keys`` are columns or struct paths; ``kind`` keeps one owner kind.
    """
    ref = controller(F.col(owner))
    wanted = ref.isNotNull() if kind is None else ref["kind"] == kind
    return changes.where(wanted).select(*keys).distinct()
