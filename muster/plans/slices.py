"""Previous-row lookups over per-key logs, without one task per key.

``lag`` over ``partitionBy(key)`` sorts all rows of a key in one task. When one key may
hold a third of the table that task never ends, and adaptive execution does not split
window partitions. Here the log of a *hot* key is first cut into contiguous slices, each
an own window partition; the last row of a slice is copied in front of the next slice, so
the result is the same as with the plain window.

Hot are keys with more than ``min_rows`` rows and more than ``1 / MAX_HOT`` of the table.
There are fewer than ``MAX_HOT`` of these whatever the data, which bounds the broadcast
table of hot keys, and every other key holds no more than a usual shuffle partition of a
table that large: it takes the plain window, one shuffle of the rows.

Slices have equal width along the first order column, or along the second where all rows
share the first. A log with bursts fills them unevenly, so slices that are still hot are
cut once more, by the same rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_HOT = 100_000
MIN_ROWS = 1_000_000
# A hot log is cut into more slices than its size asks for, as some will hold more than others.
OVERSAMPLE = 16


def number_of(name: str, dtype: T.DataType) -> str | None:
    """SQL for column ``name`` as a number that grows with it, whatever the session time
    zone; None for types without one."""
    if isinstance(dtype, T.TimestampNTZType):
        minutes = f"(unix_date(date({name})) * 24L + hour({name})) * 60 + minute({name})"
        micros = f"bigint(extract(SECOND FROM {name}) * 1000000)"
        return f"(({minutes}) * 60000000 + {micros})"
    if isinstance(dtype, T.TimestampType):
        return f"unix_micros({name})"
    return name if isinstance(dtype, T.NumericType) else None


def hot_spans(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    min_rows: int,
    whole: DataFrame | None = None,
) -> DataFrame:
    """The groups to be cut, fewer than ``MAX_HOT``: ``(_hot_<by>, _axis, _from, _step)``.
    ``_axis`` is the position in ``order`` of the column to cut along; ``whole`` is the
    table that a group's share is taken of (None: ``rows``)."""
    schema = rows.schema
    types = [schema[c].dataType for c in order[:2]]
    total = (rows if whole is None else whole).select(F.count(F.lit(1)) / MAX_HOT).scalar()
    stats = (
        rows.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.min(c).alias(f"_lo{i}") for i, c in enumerate(order[:2])],
            *[F.max(c).alias(f"_hi{i}") for i, c in enumerate(order[:2])],
        )
        .where(F.col("_n") > min_rows)
        .withColumn("_bound", F.greatest(F.lit(float(min_rows)), total))
        .where(F.col("_n") > F.col("_bound"))
    )
    cells = f"ceil(_n / _bound) * {OVERSAMPLE}"

    def span(i: int) -> str:
        low, high = (number_of(f"_{end}{i}", types[i]) for end in ("lo", "hi"))
        step = f"floor((double({high}) - double({low})) / ({cells})) + 1"
        return f"named_struct('axis', {i}, 'from', double({low}), 'step', double({step}))"

    choice = span(0)
    if len(types) > 1 and isinstance(types[1], T.NumericType):
        choice = f"CASE WHEN _lo0 = _hi0 THEN {span(1)} ELSE {choice} END"
    return stats.select("*", F.expr(choice).alias("_span")).select(
        *[F.col(c).alias(f"_hot_{c}") for c in by],
        *[F.col(f"_span.{field}").alias(f"_{field}") for field in ("axis", "from", "step")],
    )


def _slice(number: str, dtype: T.DataType) -> str:
    """SQL for the slice of a place on the axis: nulls before all others, NaN after them."""
    place = f"coalesce(bigint(floor((double({number}) - _from) / _step)), -1L)"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"CASE WHEN isnan({number}) THEN {2**62}L ELSE {place} END"
    return place


def _cut(
    rows: DataFrame,
    spans: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str,
    how: str = "left",
) -> DataFrame:
    """Adds the slice number ``name``, null for rows of groups that stay whole. Rows
    without a place on the axis come first, as in the window's order."""
    schema = rows.schema
    numbers = [number_of(f"`{c}`", schema[c].dataType) for c in order[:2]]
    slices = " ".join(
        f"WHEN _axis = {i} THEN {_slice(number, schema[c].dataType)}"
        for i, (c, number) in enumerate(zip(order, numbers))
        if number is not None
    )
    same = [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in by]
    # Fewer than MAX_HOT rows of a few numbers: a proven bound for the broadcast.
    joined = rows.join(F.broadcast(spans), reduce(lambda a, b: a & b, same), how)
    return joined.withColumn(name, F.expr(f"CASE {slices} END")).drop(*spans.columns)


def with_previous(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    prev: str = "prev",
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Adds ``prev``: a struct of ``columns`` as they were in the key's preceding row,
    null for the first row of a key.

    ``order`` must be unique within a key and start with a timestamp or number. ``rows`` is
    read several times (count, sizes, rows, and twice the hot rows), so it should be a table.
    """
    keys, order = list(keys), list(order)
    spans = hot_spans(rows, keys, order, min_rows)
    hot = _cut(rows, spans, keys, order, "_slice", how="inner")
    by_slice = [*keys, "_slice"]
    sub_spans = hot_spans(hot, by_slice, order, min_rows, whole=rows)

    sliced = _cut(rows, spans, keys, order, "_slice")
    sliced = _cut(sliced, sub_spans, by_slice, order, "_part").withColumn("_copy", F.lit(False))

    carried = list(dict.fromkeys([*order, *columns]))
    place = F.struct("_slice", "_part")
    last_rows = (
        _cut(hot, sub_spans, by_slice, order, "_part")
        .groupBy(*keys, place.alias("_place"))
        .agg(F.max_by(F.struct(*carried), F.struct(*order)).alias("_last"))
    )
    next_place = F.lead("_place").over(Window.partitionBy(*keys).orderBy("_place"))
    copies = (
        last_rows.withColumn("_place", next_place)
        .where(F.col("_place").isNotNull())
        .select(*keys, "_place.*", F.lit(True).alias("_copy"), "_last.*")
    )
    within = Window.partitionBy(*keys, "_slice", "_part").orderBy(*order)
    return (
        sliced.unionByName(copies, allowMissingColumns=True)
        .withColumn(prev, F.lag(F.struct(*columns)).over(within))
        .where(~F.col("_copy"))
        .drop("_slice", "_part", "_copy")
    )
