"""Application lifecycle from driver phases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.plans.slices import number_of

# The phases that end an application.
FINISHED = ("Succeeded", "Failed")


def phase_condition(phase: Column, ready: Column, already_running: Column) -> Column:
    """The condition a driver's phase reports, null for none."""
    return F.when(
        (phase == "Running") & F.coalesce(ready, F.lit(False)) & ~already_running, "Running"
    ).when(phase.isin(*FINISHED), phase)


def _place(phases: DataFrame, order: Sequence[str], code: Column) -> tuple[Column, str]:
    """A value whose minimum is the first row's by ``order``, and SQL for ``code`` (0 to 3)
    of a ``{place}``.

    A timestamp, alone or with a whole number, fits one DECIMAL: a hash aggregate keeps its
    minimum in place. Any other order is a struct, which Spark aggregates by sorting.
    """
    first, *rest = [phases.schema[c].dataType for c in order]
    is_time = isinstance(first, (T.TimestampType, T.TimestampNTZType))
    if not is_time or len(rest) > 1 or not all(isinstance(t, T.IntegralType) for t in rest):
        return F.struct(*order, code.alias("code")), "{place}.code"
    tie = f"`{order[1]}`" if rest else "0"
    # 59 bits of microseconds, 64 of the number (from zero on) and 2 of the code: 38 digits.
    packed = f"(cast({number_of(f'`{order[0]}`', first)} as decimal(20, 0)) * {2**64}BD + {tie} + {2**63}BD) * 4BD"
    place = F.expr(f"cast({packed} as decimal(38, 0))") + code
    valid = F.col(order[0]).isNotNull() & F.col(order[-1]).isNotNull()
    return F.when(valid, place.cast("decimal(38, 0)")), "cast(pmod({place}, 4BD) as int)"


def lifecycles(
    phases: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    phase: str = "phase",
    ready: str = "ready",
) -> DataFrame:
    """``(*keys, state, start_time, running_time, completion_time, seconds)`` per application.

    The first finishing phase decides the state and the completion time; nothing after it
    counts. Before it the first Running and ready report makes the state Running; with
    neither the application is only Created. All are minima, combined before the shuffle.
    ``order`` is (time, tie breakers ...).
    """
    time = order[0]
    col = F.col(phase)
    finished = col.isin(*FINISHED)
    runs = (col == "Running") & F.coalesce(F.col(ready), F.lit(False))
    code = F.coalesce(F.array_position(F.array(*map(F.lit, FINISHED)), col), F.lit(0)).cast("int")
    place, code_of = _place(phases, order, code)
    firsts = phases.groupBy(*keys).agg(
        F.min(time).alias("start_time"),
        F.min(F.when(finished, F.col(time))).alias("_end_time"),
        F.min(F.when(runs, F.col(time))).alias("_run_time"),
        F.min(F.when(finished, place)).alias("_end"),
        F.min(F.when(runs, place)).alias("_run"),
    )
    ran = F.col("_run").isNotNull() & (F.col("_end").isNull() | (F.col("_run") < F.col("_end")))
    ended = F.expr(code_of.format(place="_end"))
    end = F.coalesce(*[F.when(ended == i, name) for i, name in enumerate(FINISHED, 1)])
    return firsts.select(
        *keys,
        F.coalesce(end, F.when(ran, "Running"), F.lit("Created")).alias("state"),
        "start_time",
        F.when(ran, F.col("_run_time")).alias("running_time"),
        F.col("_end_time").alias("completion_time"),
        F.timestamp_diff("SECOND", F.col("start_time"), F.col("_end_time")).alias("seconds"),
    )
