import pytest
from conftest import rows
from pyspark.sql import functions as F

from muster.functions.labels import matches, merge
from muster.operators import ownership
from muster.sources.objects import get_object, list_objects

CLAIMS = [
    # ref, match, owner deleting, terminating, action
    (2, True, False, False, "ignored_foreign"),
    (2, True, True, True, "ignored_foreign"),
    (1, True, False, False, "owned"),
    (1, True, True, True, "owned"),
    (1, False, False, False, "release"),
    (1, False, True, False, "ignored_deleting"),
    (None, True, True, False, "ignored"),
    (None, True, True, True, "ignored"),
    (None, False, False, False, "ignored"),
    (None, True, False, True, "ignored_terminating"),
    (None, True, False, False, "adopt"),
]


@pytest.mark.parametrize("deleting", [False, True])
def test_claims(spark, deleting):
    cases = [c for c in CLAIMS if c[2] is deleting]
    objects = spark.createDataFrame(
        [(i, "ns", c[0], c[1], c[3]) for i, c in enumerate(cases)],
        "id int, scope string, ref_uid int, match boolean, terminating boolean",
    )
    owners = spark.createDataFrame(
        [("ns", 1, deleting), ("elsewhere", 2, False)], "scope string, uid int, deleting boolean"
    )
    found = ownership.classify_claims(objects, owners, ["scope"]).orderBy("id").collect()
    assert [r.action for r in found] == [c[4] for c in cases]


def test_resolution_checks_the_uid(spark):
    owners = spark.createDataFrame(
        [("Cluster", "ns", "a", "u1"), ("Cluster", "ns", "b", "u2")],
        "kind string, namespace string, name string, uid string",
    )
    dependents = spark.createDataFrame(
        [
            (1, "Cluster", "ns", "a", "u1"),
            (2, "Cluster", "ns", "a", "recreated"),
            (3, "Cluster", "other", "a", "u1"),
            (4, "App", "ns", "a", "u1"),
            (5, "Cluster", "ns", "b", None),
            (6, "Cluster", "ns", "b", "u2"),
        ],
        "id int, kind string, namespace string, name string, ref_uid string",
    )
    found = ownership.resolve_owners(dependents, owners, {k: k for k in ownership.OWNER_KEY})
    assert rows(found.select("id")) == [(1,), (6,)]


@pytest.mark.parametrize(
    ("destination", "source", "expected"),
    [
        ({"a": "1", "b": "2"}, {"b": "3", "c": "4"}, {"a": "1", "b": "3", "c": "4"}),
        (None, {"a": "1"}, None),
        ({"a": "1"}, None, {"a": "1"}),
        ({}, {"a": "1"}, {"a": "1"}),
    ],
)
def test_merge(spark, destination, source, expected):
    frame = spark.createDataFrame(
        [(destination, source)], "d map<string, string>, s map<string, string>"
    )
    assert frame.select(merge(F.col("d"), F.col("s"))).first()[0] == expected


def test_mark_matching(spark):
    objects = spark.createDataFrame(
        [(1, {"app": "x", "state": "ok"}), (2, {"app": "y"}), (3, None)],
        "id int, labels map<string, string>",
    )
    marked = ownership.mark_matching(objects, {"state": "deleting"}, {"app": "x"})
    assert {r.id: r.labels for r in marked.collect()} == {
        1: {"app": "x", "state": "deleting"},
        2: {"app": "y"},
        3: None,
    }


def test_listing(spark):
    objects = spark.createDataFrame(
        [
            ("ns", "a", {"app": "x", "role": "r"}),
            ("ns", "b", {"app": "x"}),
            ("other", "a", {"app": "x", "role": "r"}),
            ("ns", "c", None),
        ],
        "namespace string, name string, labels map<string, string>",
    )

    def names(frame):
        return rows(frame.select("namespace", "name"))

    assert names(list_objects(objects, "ns", {"app": "x", "role": "r"})) == [("ns", "a")]
    assert len(names(list_objects(objects, selector={"app": "x"}))) == 3
    assert len(names(list_objects(objects, "ns"))) == 3
    assert names(list_objects(objects, where=F.lit(False))) == []
    assert len(names(list_objects(objects, where=F.lit(True)))) == 4
    assert names(get_object(objects, "other", "a")) == [("other", "a")]
    assert names(get_object(objects, "other", "z")) == []


def test_selector_on_a_built_map_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).selectExpr("id", "'x' as app").write.parquet(path)
    objects = spark.read.parquet(path).select(
        "id", F.create_map(F.lit("app"), "app").alias("labels")
    )
    found = objects.where(matches(F.col("labels"), {"app": "x"})).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(app,x)" in plan


def test_reclaim(spark):
    clusters = spark.createDataFrame(
        [("ns", n) for n in "abcdef"], "namespace string, name string"
    )
    done, running = [("Succeeded", "True")], [("Running", "True")]
    apps = spark.createDataFrame(
        [
            ("ns", "a", done, None),
            ("ns", "b", done, True),
            ("ns", "c", [("Failed", "True")], False),
            ("ns", "d", running, True),
            ("elsewhere", "e", done, True),
            ("ns", "f", None, True),
            ("ns", "a", done, True),
        ],
        "namespace string, name string, "
        "conditions array<struct<type: string, status: string>>, delete_on_termination boolean",
    )
    found = ownership.reclaimable_clusters(clusters, apps)
    assert rows(found) == [("ns", "a"), ("ns", "b")]


def test_a_hot_owner_is_split_over_tasks(spark):
    """Half of the dependents belong to one owner; no side is small enough to broadcast."""
    session = spark.newSession()
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.shuffle.partitions": "16",
    }.items():
        session.conf.set(key, value)
    name = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 1000)
    dependents = session.range(0, 200_000, 1, 8).select(
        "id", name.alias("name"), name.alias("ref_uid"), F.repeat(F.lit("x"), 20).alias("pad")
    )
    owners = session.range(1000).select(F.col("id").alias("name"), F.col("id").alias("uid"))
    found = ownership.resolve_owners(dependents, owners, {"name": "name"}).select("dep.id")
    assert len(found.collect()) == 200_000
    assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
