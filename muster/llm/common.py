"""What several operators share: written tables, components, words of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.session import shared_folder

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def written(spark: SparkSession, frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, no lineage before it.

    Executors that are lost later cost no more than reading it again.
    """
    path = shared_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of the undirected links (a, b), both long and not null.

    Returns (node, root) for every node that some link names; root is the smallest node of
    the component. A node linked only to itself is not returned.

    Alternates two steps until nothing changes (a number of rounds that grows with the
    logarithm of the nodes): every node hands its larger neighbours to its smallest one,
    then its smaller neighbours likewise. Links stay as many as they were, each round is a
    table of its own, and minima are combined before they are joined, so that a node with
    very many links is split like any skewed join key.
    """
    now = written(
        spark,
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "links",
    )
    before, after = None, _state(now)
    while after[0] and before != after:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = written(
            spark,
            both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(),
            "links",
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        spread = least.hint("rebalance")
        small = large.join(spread, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = written(spark, small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        before, after = after, _state(now)
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)


#: Stands for a null doc_id where rows pass through pandas, which has no null integers.
NO_ID = -(1 << 63)


def whole_id(doc_id: Column) -> Column:
    """A doc_id that pandas keeps exact: NO_ID for null."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def null_id(doc_id: Column) -> Column:
    """Back again: null for NO_ID."""
    return F.nullif(doc_id, F.lit(NO_ID))
