"""Tokenising, counting and key-sorted layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the delimiters of the default tokeniser. Narrower than \s, which
# would also split on the vertical tab.
DELIMITERS = " \t\n\r\f"


def tokens(text: Column) -> Column:
    """The non-empty tokens of ``text`` in order; case and punctuation are kept."""
    return F.array_remove(F.split(text, f"[{DELIMITERS}]"), "")


def tokenize(lines: DataFrame, text: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """One row ``(*keep, word)`` per token."""
    return lines.select(*keep, F.explode(tokens(F.col(text))).alias("word"))


def count_words(words: DataFrame, keys: Sequence[str] = ("word",)) -> DataFrame:
    """``(*keys, n)``. Spark counts within each input partition before the shuffle,
    so a word that makes up much of the text costs one row per map task."""
    return words.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(counts: DataFrame, keys: Sequence[str] = ("word",), n: str = "n") -> DataFrame:
    """Adds up counts that were taken separately (per file, per day, per source)."""
    return counts.groupBy(*keys).agg(F.sum(n).alias(n))


def word_count(lines: DataFrame, text: str = "value") -> DataFrame:
    """``(word, n)`` over all rows of ``lines``."""
    return count_words(tokenize(lines, text))


def sorted_by_key(
    counts: DataFrame, keys: Sequence[str] = ("word",), partitions: int | None = None
) -> DataFrame:
    """Hash-partitions by ``keys`` and sorts each partition: each output file is in
    byte order of the key, files are not ordered among themselves.

    Without ``partitions`` the aggregate's own partitioning is kept, which saves a
    shuffle. With it the (already reduced) counts are shuffled once more.
    """
    if partitions is not None:
        counts = counts.repartition(partitions, *keys)
    return counts.sortWithinPartitions(*keys)
