"""Condition lists from logs of (type, reason) reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.conditions import CLUSTER_TYPES
from muster.plans.slices import MIN_ROWS, with_previous


def report_summaries(
    reports: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    types: Sequence[str] = CLUSTER_TYPES,
    type_: str = "type",
    reason: str = "reason",
    message: str | None = None,
    continued: bool = False,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """``(*keys, entries)``: what matters of each object's log, one row per object.

    Per type, in the order of their last valid report: ``type, reason, message`` and
    ``updated`` (time) of that report, and ``since``, when the type last became True. For
    logs that may be ``continued`` from others, ``only_first`` and ``from_first`` say that
    the report, or that moment, is the first of the log: these depend on what came before.
    Then entries also hold the place ``at`` (a struct of ``order``) of the report, and each
    row the places ``first`` and ``last`` of all its reports, void ones too.

    Exactly one type is True at any time, that of the preceding report, so comparing each
    report with its predecessor is enough, and the rest are maxima per type: one shuffle of
    the reports, then one row per object and task. ``order`` is (time, unique id). Types
    are a closed set; another type is an error, not a dropped row.
    """
    time = order[0]
    text = F.col(message) if message else F.lit(None).cast("string")
    log = with_previous(reports, keys, order, [type_, reason], min_rows=min_rows)
    was_type = F.col(f"prev.{type_}").eqNullSafe(F.col(type_))
    was_same = was_type & F.col(f"prev.{reason}").eqNullSafe(F.col(reason))
    # Void reports add nothing to the maxima. A start is compared with the first report
    # only in continued logs; otherwise its time alone is cheaper to aggregate.
    start = F.struct(*order) if continued else F.col(time)
    log = log.withColumns(
        {
            "_type": F.when(F.col(type_).isin(*types), F.col(type_)).otherwise(
                F.raise_error(F.concat(F.lit("unknown condition type "), F.col(type_)))
            ),
            "_at": F.struct(*order),
            "_report": F.struct(*order, F.col(reason).alias("_reason"), text.alias("_text")),
            "_start": F.when(~was_type, start),
        }
    )
    # A continued log's places are those of void reports, too.
    log = log.withColumn("_type", F.when(~was_same, F.col("_type"))) if continued else log.where(~was_same)

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("_type") == kind, F.col(column)))

    first = [F.min("_at").alias("_first"), F.max("_at").alias("_last")] if continued else []
    state = log.groupBy(*keys).agg(
        *first,
        *[of(k, "_report").alias(f"_report_{i}") for i, k in enumerate(types)],
        *[of(k, "_start").alias(f"_start_{i}") for i, k in enumerate(types)],
    )

    def entry(i: int, kind: str) -> Column:
        report, start = f"_report_{i}", f"_start_{i}"
        at = f"struct({', '.join(f'{report}.`{c}`' for c in order)})"
        fields = {
            "type": f"'{kind}'",
            "reason": f"{report}._reason",
            "message": f"{report}._text",
            "updated": f"{report}.`{time}`",
            "since": f"{start}.`{time}`" if continued else start,
        }
        if continued:
            fields |= {"only_first": f"{at} = _first", "from_first": f"{start} = _first", "at": at}
        pairs = ", ".join(f"'{name}', {value}" for name, value in fields.items())
        return F.expr(
            f"CASE WHEN {report} IS NOT NULL "
            f"THEN struct({at} AS at, named_struct({pairs}) AS entry) END"
        )

    present = F.array_sort(F.array_compact(F.array(*[entry(i, k) for i, k in enumerate(types)])))
    places = [F.col("_first").alias("first"), F.col("_last").alias("last")] if continued else []
    return state.select(*keys, *places, F.transform(present, lambda e: e["entry"]).alias("entries"))


def condition_lists(
    reports: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    types: Sequence[str] = CLUSTER_TYPES,
    type_: str = "type",
    reason: str = "reason",
    message: str | None = None,
    reconfiguring: str | None = "Reconfiguring",
    running: str = "Running",
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """``(*keys, conditions)``: each object's condition list after all its reports.

    A report is void if its type is currently True with the same reason. Otherwise that
    type becomes True and goes last, and all others become False; its last transition
    stays if it was True already (only the reason changed). A ``reconfiguring`` report
    removes ``running`` (None: nothing is removed, as for applications).
    """
    found = report_summaries(
        reports, keys, order, types, type_, reason, message, min_rows=min_rows
    )
    return listed(found, keys, reconfiguring, running)


def listed(
    found: DataFrame,
    keys: Sequence[str],
    reconfiguring: str | None = "Reconfiguring",
    running: str = "Running",
) -> DataFrame:
    """``(*keys, conditions)`` from the entries of :func:`report_summaries`."""
    kinds = F.transform("entries", lambda e: e["type"])
    removed = F.lit(False)
    if reconfiguring is not None:
        removed = F.array_position(kinds, reconfiguring) > F.array_position(kinds, running)
    kept = F.filter("entries", lambda e: (e["type"] != running) | ~F.col("_removed"))
    conditions = F.transform(
        "_kept",
        lambda e, i: F.struct(
            e["type"].alias("type"),
            F.when(i == F.size("_kept") - 1, "True").otherwise("False").alias("status"),
            e["reason"].alias("reason"),
            e["message"].alias("message"),
            e["updated"].alias("last_update"),
            e["since"].alias("last_transition"),
        ),
    )
    return (
        found.withColumn("_removed", removed)
        .withColumn("_kept", kept)
        .select(*keys, conditions.alias("conditions"))
    )


def condition_rows(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row ``(*keys, position, type, status, ...)`` per condition, position from 1."""
    exploded = lists.select(*keys, F.posexplode("conditions").alias("_pos", "_condition"))
    return exploded.select(*keys, (F.col("_pos") + 1).alias("position"), "_condition.*")
