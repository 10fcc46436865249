"""Text sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _as_lines(rows: DataFrame, columns: Sequence[str] | None, sep: str) -> DataFrame:
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or rows.columns]
    return rows.select(F.concat_ws(sep, *cols).alias("value"))


def write_lines(
    rows: DataFrame, path: str, columns: Sequence[str] | None = None, sep: str = "\t"
) -> None:
    """Writes ``sep``-joined text lines; fails if ``path`` exists."""
    _as_lines(rows, columns, sep).write.mode("errorifexists").text(path)


def write_lines_if_absent(
    rows: DataFrame, path: str, columns: Sequence[str] | None = None, sep: str = "\t"
) -> None:
    """Writes text lines unless ``path`` exists, in which case nothing is computed."""
    _as_lines(rows, columns, sep).write.mode("ignore").text(path)
