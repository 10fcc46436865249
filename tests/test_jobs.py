"""Jobs with user functions against the same in plain Python."""

import random
import sys
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest import rows
from pyspark import cloudpickle

from muster.operators.jobs import Job


# Workers cannot import a test module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def words(batch):
    lists = pc.split_pattern_regex(batch["text"], "[ \t\n\r\f]+")
    found = pc.list_flatten(lists)
    found = found.filter(pc.not_equal(found, ""))
    return pa.table({"word": found, "n": pa.array([1] * len(found), pa.int64())})


def total(table):
    return table.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def lines(seed, n=400):
    rng = random.Random(seed)
    return [" ".join(["hot"] * rng.randrange(9) + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(9))]) for _ in range(n)]


@pytest.mark.parametrize("held", [5, 10**6])
def test_word_count(spark, held):
    texts = lines(1)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    found = Job(words, ["word"], "word string, n bigint", total).run(frame, salts=3, held=held)
    assert rows(found) == sorted(Counter(w for t in texts for w in t.split()).items(), key=repr)
    assert Job(words, ["word"], "word string, n bigint", total).run(frame.limit(0)).count() == 0


def test_rows_are_combined_before_the_exchange(spark):
    frame = spark.createDataFrame([("hot " * 1000,)] * 64, "text string").repartition(4)
    found = Job(words, ["word"], "word string, n bigint", total).run(frame)
    plan = found._jdf.queryExecution().executedPlan().toString()
    first, *_ = [line for line in plan.splitlines()[::-1] if "Exchange hashpartitioning(word" in line]
    assert "_salt" in first
    below = plan[plan.index(first) :]
    assert "MapInArrow" in below
    # 64,000 words leave the four map tasks as four rows.
    mapped = found._jdf.queryExecution().sparkPlan().toString()
    assert mapped.count("MapInArrow") == 3
    assert found.collect()[0].n == 64000


def test_a_reducer_sees_all_of_a_key(spark):
    """Without combiner: medians, which need all values; a key may span many batches."""
    rng = random.Random(2)
    data = [(rng.choice(["hot", f"k{rng.randrange(30)}"]), i % 4, rng.randrange(1000)) for i in range(5000)]
    frame = spark.createDataFrame(data, "k string, g int, v bigint").repartition(6)

    def middle(key, tables):
        values = sorted(v for t in tables for v in t["v"].to_pylist())
        return pa.table({"k": [key[0]], "g": [key[1]], "middle": [values[len(values) // 2]], "n": [len(values)]})

    job = Job(lambda b: b, ["k", "g"], "k string, g int, v bigint", reducer=middle, reduced="k string, g int, middle bigint, n bigint")
    by = defaultdict(list)
    for k, g, v in data:
        by[k, g].append(v)
    want = [(*kg, sorted(v)[len(v) // 2], len(v)) for kg, v in by.items()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert rows(job.run(frame)) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_combiner_and_reducer(spark):
    """A mean by sums and counts; the reducer leaves a key's later tables unread."""
    data = [(f"k{i % 7}", float(i)) for i in range(1000)]
    frame = spark.createDataFrame(data, "k string, v double").repartition(5)

    def pair(batch):
        return pa.table({"k": batch["k"], "total": batch["v"], "n": pa.array([1] * len(batch), pa.int64())})

    def add(table):
        found = table.group_by("k").aggregate([("total", "sum"), ("n", "sum")])
        return found.rename_columns(["k", "total", "n"])

    def mean(key, tables):
        only = next(tables)
        return pa.table({"k": [key[0]], "mean": [only["total"][0].as_py() / only["n"][0].as_py()]})

    job = Job(pair, ["k"], "k string, total double, n bigint", add, mean, "k string, mean double")
    want = [(f"k{j}", sum(v for k, v in data if k == f"k{j}") / len(range(j, 1000, 7))) for j in range(7)]
    assert rows(job.run(frame, held=10)) == want
