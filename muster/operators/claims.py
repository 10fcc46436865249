"""Claims of every owner whose selector takes an object, not of one that its key names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.operators.ownership import claim_action
from muster.plans.containment import PART, holds, satisfied


def candidate_claims(
    objects: DataFrame,
    owners: DataFrame,
    scope: Sequence[str],
    object_key: Sequence[str],
    uid: str = "uid",
    ref_uid: str = "ref_uid",
    labels: str = "labels",
    selector: str = "selector",
    deleting: str = "deleting",
    terminating: str = "terminating",
    part: int = PART,
) -> DataFrame:
    """``(object, owner, action)``: what each owner does about each object that it controls or
    that its selector takes, by :func:`muster.operators.ownership.claim_action`.

    Owners neither controlling an object nor taking it would ignore it and are not listed.
    An object whose controller is not among the owners of its scope meets takers only, who
    ignore it as another's. ``object`` and ``owner`` are structs of all columns.
    """
    ref, own = F.col(f"object.{ref_uid}"), F.col(f"owner.{uid}")
    takers = satisfied(objects, owners, scope, object_key, [uid], labels, selector, part)
    takers = takers.where(ref.isNull() | (ref != own)).withColumn("_match", F.lit(True))
    controlled = objects.where(F.col(ref_uid).isNotNull()).select(
        *[F.col(c).alias(f"_{i}") for i, c in enumerate([*scope, ref_uid])], F.struct(*objects.columns).alias("object")
    )
    named = owners.select(*scope, uid, F.struct(*owners.columns).alias("owner"))
    same = [F.col(f"_{i}") == F.col(c) for i, c in enumerate([*scope, uid])]
    controlled = controlled.join(named, same).select(
        "object", "owner", holds(F.col(f"object.{labels}"), F.col(f"owner.{selector}")).alias("_match")
    )
    action = claim_action(ref, own, F.col("_match"), F.col(f"owner.{deleting}"), F.col(f"object.{terminating}"))
    return takers.unionByName(controlled).select("object", "owner", action.alias("action"))


def adopters(
    claims: DataFrame, objects: DataFrame, object_key: Sequence[str], uid: str = "uid", ref_uid: str = "ref_uid"
) -> DataFrame:
    """``(*object_key, candidates, adopter)`` of each orphan among the objects.

    ``candidates`` counts the owners that would adopt it, 0 and a null ``adopter`` if there are
    none. Of several, whoever comes first adopts and the others find it taken; here that
    is the smallest uid. Counted before the shuffle: an orphan that very many owners want
    is one row for each task.
    """
    keys = list(object_key)
    wanted = claims.where(F.col("action") == "adopt").groupBy(*[F.col(f"object.{k}").alias(k) for k in keys])
    found = wanted.agg(F.count(F.lit(1)).alias("candidates"), F.min(f"owner.{uid}").alias("adopter"))
    orphans = objects.where(F.col(ref_uid).isNull()).select(*keys)
    return orphans.join(found, keys, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
