"""Owner resolution, claims, bulk marking and reclaiming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.conditions import is_finished
from muster.functions.labels import matches, merge

OWNER_KEY = ("kind", "namespace", "name")


def resolve_owners(
    dependents: DataFrame,
    owners: DataFrame,
    on: Mapping[str, str],
    ref_uid: str = "ref_uid",
    owner_uid: str = "uid",
) -> DataFrame:
    """Dependents joined to the owner they refer to.

    ``on`` maps reference columns of ``dependents`` to key columns of ``owners``; an owner
    found under that key but with another uid was recreated and does not count. The uid is
    part of the equi-join key, and rows without a reference leave before the shuffle. No
    side is broadcast by hint: Spark does so below its size threshold, and beyond it
    adaptive execution splits the partition of an owner with very many dependents.
    """
    owners = owners.alias("owner")
    refs = dependents.where(F.col(ref_uid).isNotNull()).alias("dep")
    keys = [F.col(f"dep.{left}") == F.col(f"owner.{right}") for left, right in on.items()]
    uid = F.col(f"dep.{ref_uid}") == F.col(f"owner.{owner_uid}")
    return refs.join(owners, [*keys, uid], "inner")


def claim_action(
    ref_uid: Column, owner_uid: Column, match: Column, owner_deleting: Column, terminating: Column
) -> Column:
    """What an owner does about one object; ``match`` is its selector on that object.

    An object controlled by someone else is ignored. One's own object is kept while it
    matches, else released unless the owner is being deleted (``ignored_deleting``). An
    orphan is ignored if the owner is being deleted or does not match it, or if it is
    itself terminating (``ignored_terminating``), else adopted.
    """
    match = F.coalesce(match, F.lit(False))
    owned = (
        F.when(ref_uid != owner_uid, "ignored_foreign")
        .when(match, "owned")
        .when(owner_deleting, "ignored_deleting")
        .otherwise("release")
    )
    orphan = (
        F.when(owner_deleting | ~match, "ignored")
        .when(terminating, "ignored_terminating")
        .otherwise("adopt")
    )
    return F.when(ref_uid.isNotNull(), owned).otherwise(orphan)


def classify_claims(
    objects: DataFrame,
    owners: DataFrame,
    on: Sequence[str],
    ref_uid: str = "ref_uid",
    owner_uid: str = "uid",
    match: str = "match",
    owner_deleting: str = "deleting",
    terminating: str = "terminating",
) -> DataFrame:
    """Objects with the ``action`` of their candidate owner.

    ``on`` names the scope columns under which an owner is unique (namespace and the name
    an object's labels give), so every object meets one candidate, never all of a
    namespace.
    """
    return objects.join(owners, list(on), "inner").withColumn(
        "action",
        claim_action(
            F.col(ref_uid),
            F.col(owner_uid),
            F.col(match),
            F.col(owner_deleting),
            F.col(terminating),
        ),
    )


def mark_matching(
    objects: DataFrame,
    marks: Mapping[str, str] | Column,
    selector: Mapping[str, str] | Column,
    labels: str = "labels",
) -> DataFrame:
    """Writes ``marks`` over the labels of all objects the selector takes."""
    if not isinstance(marks, Column):
        marks = F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])
    if not isinstance(selector, Column):
        selector = matches(F.col(labels), selector)
    marked = merge(F.col(labels), marks)
    return objects.withColumn(labels, F.when(selector, marked).otherwise(F.col(labels)))


def reclaimable_clusters(
    clusters: DataFrame,
    apps: DataFrame,
    on: Sequence[str] = ("namespace", "name"),
    finished: Column | None = None,
    delete_flag: str = "delete_on_termination",
) -> DataFrame:
    """Clusters whose application of the same key has finished, unless that application
    says explicitly to keep them.

    The keys are made distinct before the shuffle, so a cluster with very many finished
    applications is one row per map task.
    """
    done = is_finished(F.col("conditions")) if finished is None else finished
    keys = apps.where(done & F.coalesce(F.col(delete_flag), F.lit(True))).select(*on).distinct()
    return clusters.join(keys, list(on), "left_semi")
