"""Which selectors an object's labels satisfy, without meeting all selectors of a scope.

A set-containment join: labels satisfy a selector if they hold every one of its pairs, so
it is enough that an object meets a selector under *one* of its pairs, and the one that
fewest objects hold makes the fewest meetings. Each selector is routed to its rarest pair;
objects go to each of their pairs that some selector is routed to; what meets is then
compared as a whole.

A pair that very many objects hold may be the rarest of a selector all the same. Such hot
pairs are salted: their objects are dealt to as many parts as the count asks for, and each
of their selectors goes to every part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.plans.slices import MAX_HOT

#: Objects of a pair that meet its selectors in one part.
PART = 100_000
#: Held by every object of a scope; the pair of selectors that have none.
ANY = "*"


def pairs(labels: Column) -> Column:
    """The pairs of a map as strings, none equal for unlike pairs or to ANY."""
    text = F.transform(
        F.map_entries(labels),
        lambda e: F.concat(F.length(e["key"]).cast("string"), F.lit(":"), e["key"], F.lit("="), e["value"]),
    )
    return F.coalesce(text, F.array().cast("array<string>"))


def holds(labels: Column, selector: Column) -> Column:
    """Whether labels hold every pair of a selector that is a column: never null."""
    each = F.forall(F.map_entries(selector), lambda e: labels[e["key"]] == e["value"])
    return F.coalesce((F.size(selector) == 0) | each, F.lit(False))


def satisfied(
    objects: DataFrame,
    owners: DataFrame,
    scope: Sequence[str],
    object_key: Sequence[str],
    owner_key: Sequence[str],
    labels: str = "labels",
    selector: str = "selector",
    part: int = PART,
) -> DataFrame:
    """``(object, owner)``, structs of all columns, for each object whose ``labels`` hold every
    pair of the ``selector`` of an owner of the same ``scope`` columns.

    The empty selector takes every object of its scope, a null one none, like one with a
    null value; null labels are none. Rows with a null in ``scope`` take no part. Keys are
    unique within a scope. Both tables are read twice: to count pairs, and to meet.
    """
    scope, owner_key = list(scope), list(owner_key)
    present = [F.col(c).isNotNull() for c in scope]
    for p in present:
        objects, owners = objects.where(p), owners.where(p)
    owners = owners.where(F.col(selector).isNotNull())
    wanted = F.when(F.size(selector) == 0, F.array(F.lit(ANY))).otherwise(pairs(F.col(selector)))
    asked = owners.select(*scope, *owner_key, F.explode(wanted).alias("_pair"))
    spread = F.xxhash64(*scope, *object_key).alias("_spread")
    held = objects.select(
        *scope, spread, F.struct(*objects.columns).alias("object"),
        F.explode(F.concat(pairs(F.col(labels)), F.array(F.lit(ANY)))).alias("_pair"),
    )
    at = [*scope, "_pair"]
    # One row for each pair and task leaves before the shuffle; then pairs no selector names go.
    counts = held.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.join(asked.select(*at).distinct(), at, "left_semi")
    rarest = (
        asked.join(counts, at, "left")
        .groupBy(*scope, *owner_key)
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_pair").alias("pair"))).alias("_route"))
        .where(F.col("_route.n") > 0)
        .select(*scope, *owner_key, F.col("_route.pair").alias("_pair"), F.col("_route.n").alias("_n"))
    )
    total = objects.select(F.count(F.lit(1)) / MAX_HOT).scalar()
    bound = F.greatest(F.lit(float(part)), total)
    # A scope's pairs are at most its objects' labels; of those above the bound there are
    # fewer than MAX_HOT for each label that an object holds.
    hot = rarest.where(F.col("_n") > bound).select(*at, F.ceil(F.col("_n") / bound).cast("int").alias("_parts")).distinct()
    hot = hot.withColumnsRenamed({c: f"_hot_{c}" for c in at})
    same = [F.col(c) == F.col(f"_hot_{c}") for c in at]

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(hot, same, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    routed = dealt(owners.select("*", F.struct(*owners.columns).alias("owner")).join(rarest.drop("_n"), [*scope, *owner_key]))
    routed = routed.select(*at, "owner", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    placed = dealt(held).select(*at, "object", F.pmod("_spread", "_parts").cast("int").alias("_part"))
    met = placed.join(routed, [*at, "_part"])
    return met.where(holds(F.col(f"object.{labels}"), F.col(f"owner.{selector}"))).select("object", "owner")
