import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from muster.plans import slices

START = datetime(2024, 1, 1)


def log(shape, seed=1):
    """900 rows, a third of them of one key: even, in a burst, or all at one instant. Keys
    may be null, timestamps repeat."""
    rng = random.Random(seed)
    offset = {
        "even": lambda i: rng.randrange(100_000),
        "burst": lambda i: rng.randrange(100_000) if i % 30 == 0 else 5 + rng.random() / 10,
        "instant": lambda i: 7,
        "two instants": lambda i: 7 if i % 30 else 90_000,
    }[shape]
    data = []
    for i in range(900):
        key = 7 if i % 3 == 0 else rng.choice([None, 1, 2, 3, 4, 5, 6])
        at = START + timedelta(seconds=offset(i) if key == 7 else rng.randrange(100_000))
        data.append((key, at, i, rng.choice("abc")))
    return data


def plain(frame, keys, order):
    lag = F.lag(F.struct("v")).over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("prev", lag)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("shape", ["even", "burst", "instant", "two instants"])
@pytest.mark.parametrize("min_rows", [1, 20, 10_000])
def test_equals_plain_window(spark, kind, shape, min_rows):
    frame = spark.createDataFrame(log(shape), f"key int, ts {kind}, id int, v string")
    sliced = slices.with_previous(frame, ["key"], ["ts", "id"], ["v"], min_rows=min_rows)
    assert rows(sliced) == rows(plain(frame, ["key"], ["ts", "id"]))


def test_no_time_zone_moves_a_row(spark):
    """Local times around a clock change, in a session zone that has one."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "America/New_York")
    first = datetime(2024, 3, 10)
    data = [(1, first + timedelta(minutes=i), i, str(i % 7)) for i in range(300)]
    frame = session.createDataFrame(data, "key int, ts timestamp_ntz, id int, v string")
    sliced = slices.with_previous(frame, ["key"], ["ts", "id"], ["v"], min_rows=20)
    assert rows(sliced) == rows(plain(frame, ["key"], ["ts", "id"]))


def test_rows_without_a_time_come_first(spark):
    times = [None if i % 7 == 0 else START + timedelta(seconds=i) for i in range(90)]
    data = [(1, at, i, str(i % 5)) for i, at in enumerate(times)]
    frame = spark.createDataFrame(data, "key int, ts timestamp, id int, v string")
    sliced = slices.with_previous(frame, ["key"], ["ts", "id"], ["v"], min_rows=5)
    assert rows(sliced) == rows(plain(frame, ["key"], ["ts", "id"]))


def test_numeric_axis_and_two_keys(spark):
    data = [(k, k % 2, i, str(i % 5)) for i in range(200) for k in (1, 2)]
    frame = spark.createDataFrame(data, "a int, b int, pos bigint, v string")
    sliced = slices.with_previous(frame, ["a", "b"], ["pos"], ["v"], min_rows=10)
    assert rows(sliced) == rows(plain(frame, ["a", "b"], ["pos"]))


def test_text_as_second_order_column(spark):
    data = [(1, START + timedelta(seconds=i // 9), f"{i % 9}", str(i % 5)) for i in range(300)]
    frame = spark.createDataFrame(data, "key int, ts timestamp, id string, v string")
    sliced = slices.with_previous(frame, ["key"], ["ts", "id"], ["v"], min_rows=5)
    assert rows(sliced) == rows(plain(frame, ["key"], ["ts", "id"]))


def test_every_one_of_many_hot_keys_is_cut(spark):
    """5,000 keys above the threshold: no window partition exceeds it."""
    frame = spark.range(5000 * 30).selectExpr(
        "cast(id % 5000 as int) as key", "id div 5000 as pos", "cast(id % 7 as string) as v"
    )
    spans = slices.hot_spans(frame, ["key"], ["pos"], 10)
    assert spans.count() == 5000
    cut = slices._cut(frame, spans, ["key"], ["pos"], "_slice").groupBy("key", "_slice").count()
    assert cut.agg(F.max("count")).first()[0] <= 10
    sliced = slices.with_previous(frame, ["key"], ["pos"], ["v"], min_rows=10)
    assert rows(sliced) == rows(plain(frame, ["key"], ["pos"]))


def test_hot_is_a_share_of_the_table(spark, monkeypatch):
    """At most a fixed number of keys is broadcast: the others hold less than its inverse."""
    monkeypatch.setattr(slices, "MAX_HOT", 3)
    data = [(k, i, str((i * k) % 3)) for k in range(6) for i in range(200 if k == 1 else 20)]
    frame = spark.createDataFrame(data, "key int, pos bigint, v string")
    assert [r._hot_key for r in slices.hot_spans(frame, ["key"], ["pos"], 10).collect()] == [1]
    sliced = slices.with_previous(frame, ["key"], ["pos"], ["v"], min_rows=10)
    assert rows(sliced) == rows(plain(frame, ["key"], ["pos"]))


@pytest.mark.parametrize("shape", ["even", "burst", "instant", "two instants"])
def test_hot_key_is_spread(spark, shape):
    """No window partition of the hot key holds more than a fraction of its 300 rows."""
    frame = spark.createDataFrame(log(shape), "key int, ts timestamp, id int, v string")
    order, by = ["ts", "id"], ["key", "_slice"]
    spans = slices.hot_spans(frame, ["key"], order, 30)
    hot = slices._cut(frame, spans, ["key"], order, "_slice", how="inner")
    parts = slices._cut(hot, slices.hot_spans(hot, by, order, 30), by, order, "_part")
    sizes = parts.where("key = 7").groupBy("_slice", "_part").count()
    assert sizes.agg(F.sum("count")).first()[0] == 300
    assert sizes.agg(F.max("count")).first()[0] <= 30


def test_without_hot_keys_one_shuffle_of_the_rows_remains(spark):
    frame = spark.createDataFrame(log("even"), "key int, ts timestamp, id int, v string")
    found = slices.with_previous(frame, ["key"], ["ts", "id"], ["v"])
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange") == 1
    assert "Join" not in final and "Union" not in final
