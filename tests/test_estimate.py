import math

import pytest

from muster.functions.halton import digits_for, radical_inverse
from muster.operators.estimate import estimate_pi, halton_points, pi_job


def test_documented_value(spark):
    assert tuple(pi_job(spark, 8, 1000).first()) == (6282, 8000, 3.141)


def test_default_digits_give_the_same_points(spark):
    indexes = spark.range(1, 8001).withColumnRenamed("id", "point")
    assert estimate_pi(halton_points(indexes, "point")).first().inside == 6282


@pytest.mark.parametrize(
    ("largest", "base", "digits"), [(1, 2, 1), (2, 2, 2), (8, 3, 2), (9, 3, 3)]
)
def test_digits(largest, base, digits):
    assert digits_for(largest, base) == digits


@pytest.mark.parametrize("base", [2, 3])
def test_radical_inverse(spark, base):
    def mirrored(n):
        value, weight = 0.0, 1.0 / base
        while n:
            value, n, weight = value + (n % base) * weight, n // base, weight / base
        return value

    found = spark.range(0, 1000).select("id", radical_inverse("id", base).alias("v")).collect()
    assert all(abs(r.v - mirrored(r.id)) < 1e-12 for r in found)


def test_more_points_come_closer(spark):
    def error(samples):
        return abs(pi_job(spark, 8, samples).first().pi - math.pi)

    assert error(40_000) < error(1_000)
