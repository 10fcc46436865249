"""Reads through the index against the plain scan, and what they read."""

import random
import re

import pytest
from conftest import rows

from muster.sources.index import ObjectIndex
from muster.sources.objects import get_object, list_objects

SCHEMA = "namespace string, name string, labels map<string,string>, _home int, _pair string"


@pytest.fixture(scope="module")
def objects(spark):
    rng = random.Random(4)
    data = [
        (rng.choice(["n", "m"]), f"o{i}", rng.choice([None, {}, *[{"hot": "1"} | {k: rng.choice("xyz") for k in rng.sample("abc", rng.randrange(4))}] * 8]), i, "p")
        for i in range(500)
    ]
    return spark.createDataFrame([*data, (None, "o1", {"a": "x"}, 0, ""), ("n", None, {"a": "x"}, 0, "")], SCHEMA)


@pytest.fixture(scope="module")
def index(spark, objects, tmp_path_factory):
    made = ObjectIndex(str(tmp_path_factory.mktemp("index") / "i"), buckets=16)
    made.write(objects.drop("_home", "_pair"))
    return made


SELECTORS = [{}, {"hot": "1"}, {"a": "x"}, {"hot": "1", "a": "x"}, {"a": "x", "b": "y", "c": "z"}, {"a": "none"}, {"a": "x", "no": "1"}]


@pytest.mark.parametrize("selector", SELECTORS, ids=str)
def test_selectors_equal_the_scan(spark, objects, index, selector):
    for namespace in ("n", "m", "elsewhere"):
        want = list_objects(objects.where("name is not null"), namespace, selector)
        got = index.select(spark, namespace, selector)
        assert rows(got.select("namespace", "name", "labels")) == rows(want.select("namespace", "name", "labels"))


def read_partitions(frame):
    """What the scans of a plan are asked for, table by table."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)


def test_a_lookup_reads_one_bucket(spark, objects, index):
    for namespace, name in (("n", "o1"), ("m", "o1"), ("n", "o77")):
        got, want = index.get(spark, namespace, name), get_object(objects, namespace, name)
        assert rows(got.select("namespace", "name")) == rows(want.select("namespace", "name"))
    (filters,) = read_partitions(index.get(spark, "n", "o1"))
    assert re.search(r"\(_bucket#\d+ = \d+\)", filters)


def test_a_selector_reads_a_bucket_of_postings_each(spark, index):
    found = read_partitions(index.select(spark, "n", {"hot": "1", "a": "x"}))
    assert len([f for f in found if re.search(r"\(_bucket#\d+ = \d+\)", f)]) >= 2
    # Objects: only the buckets that the postings name.
    assert any("dynamicpruning" in f for f in found)


def test_an_index_of_nothing(spark, objects, tmp_path):
    made = ObjectIndex(str(tmp_path / "i"))
    made.write(objects.limit(1))
    assert made.get(spark, "n", "nobody").count() == 0
    assert made.select(spark, "n", {"nothing": "1"}).count() == 0
