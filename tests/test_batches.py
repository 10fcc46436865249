"""Streams give the same answer however the input is cut into micro-batches."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from conftest import rows
from muster.functions.halton import radical_inverse
from muster.operators.replicas import cluster_readiness
from muster.plans.slices import with_previous
from muster.streaming import feed as feeds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The given tables, with events as two files written in order of time or against it."""
    top = tmp_path_factory.mktemp("cut")
    events = spark.read.parquet(f"{SF}/events.parquet")
    times = sorted(r.ts for r in events.select("ts").collect())
    half = times[len(times) // 2]
    for name, order in (("ordered", (True, False)), ("mixed", (False, True))):
        folder = top / name
        folder.mkdir()
        for x in ("documents", "orders", "customer", "lineitem", "labels", "supplier"):
            (folder / f"{x}.parquet").symlink_to(f"{SF}/{x}.parquet")
        for early in order:
            part = events.where(F.col("ts") <= half) if early else events.where(F.col("ts") > half)
            part.coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
    return top


@pytest.fixture
def cut(monkeypatch):
    plain = feeds.read_feed
    monkeypatch.setattr(feeds, "read_feed", lambda *a, **b: plain(*a, **{**b, "max_bytes": 1}))


@pytest.mark.parametrize("name", ["ordered", "mixed"])
@pytest.mark.parametrize("query", ["feed_filter", "owner_fan_in"])
def test_stream_equals_batch(spark, tables, cut, query, name):
    folder = str(tables / name)
    whole, streamed = (registry.queries()[q](spark, folder) for q in (query, f"{query}_stream"))
    assert rows(streamed) == rows(whole) != []


@pytest.mark.parametrize("name", ["ordered", "mixed"])
def test_conditions_in_any_order(spark, tables, cut, name):
    folder = str(tables / name)
    assert rows(registry.queries()["condition_stream"](spark, folder)) == rows(
        registry.queries()["condition_timeline"](spark, folder)
    )


def test_halton_beyond_its_digits(spark):
    frame = spark.createDataFrame([(3**30 - 1,), (5,)], "i bigint")
    assert frame.select(radical_inverse("i", 3)).count() == 2
    for index, base in ((3**30 + 5, 3), (2**48 + 5, 2)):
        wrong = spark.createDataFrame([(index,)], "i bigint").select(radical_inverse("i", base).alias("x"))
        with pytest.raises(Exception, match="no base"):
            wrong.collect()


def test_readiness_is_by_role(spark):
    data = [
        (1, "a", True), (1, "b", True),
        (2, "a", True), (2, "a", True),
        (3, "a", True), (3, "a", False), (3, "b", True),
        (4, "a", True), (4, "b", None),
        (5, "a", True), (5, "a", True), (5, "b", True), (5, "z", False),
    ]
    status = spark.createDataFrame(data, "k int, role string, ready boolean")
    found = cluster_readiness(status, ["k"], ["a", "b"]).select("k", "ready")
    assert rows(found) == [(1, True), (2, False), (3, False), (4, False), (5, True)]


def test_slices_of_nan_and_wide_ranges(spark):
    data = [(1, float("nan") if i == 50 else float(i), str(i)) for i in range(100)]
    frame = spark.createDataFrame(data, "key int, pos double, v string")
    found = with_previous(frame, ["key"], ["pos"], ["v"], min_rows=5).select("v", "prev.v")
    order = [str(i) for i in range(100) if i != 50] + ["50"]
    assert dict(map(tuple, found.collect())) == dict(zip(order, [None, *order[:-1]], strict=True))
    wide = [(1, (i - 50) * (1 << 57), str(i)) for i in range(100)]
    frame = spark.createDataFrame(wide, "key int, pos bigint, v string")
    assert with_previous(frame, ["key"], ["pos"], ["v"], min_rows=5).count() == 100
