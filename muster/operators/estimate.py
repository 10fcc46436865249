"""Quasi-Monte-Carlo estimate of pi from points in the unit square."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.halton import radical_inverse


def halton_points(indexes: DataFrame, index: str, largest: int | None = None) -> DataFrame:
    """``(index, x, y)``: Halton points of bases 2 and 3 for every (positive) index.

    ``largest`` is an upper bound of the index; knowing it shortens the expressions.
    """
    return indexes.select(
        index,
        radical_inverse(index, 2, largest).alias("x"),
        radical_inverse(index, 3, largest).alias("y"),
    )


def estimate_pi(points: DataFrame) -> DataFrame:
    """``(inside, total, pi)``: four times the share of points in the inscribed circle.

    One global aggregate; every task sends one row.
    """
    dx, dy = F.col("x") - 0.5, F.col("y") - 0.5
    counts = points.agg(
        F.count_if(dx * dx + dy * dy <= 0.25).alias("inside"), F.count(F.lit(1)).alias("total")
    )
    return counts.withColumn("pi", F.lit(4.0) * F.col("inside") / F.col("total"))


def pi_job(spark: SparkSession, maps: int, samples: int) -> DataFrame:
    """The estimate from ``maps`` tasks with ``samples`` points each."""
    total = maps * samples
    indexes = spark.range(1, total + 1, 1, maps).withColumnRenamed("id", "point")
    return estimate_pi(halton_points(indexes, "point", total))
