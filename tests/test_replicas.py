import pytest
from conftest import rows
from pyspark.sql import functions as F

from muster.operators import replicas
from muster.sources.schemas import GATING_ROLES

READY = [("Initialized", "True"), ("Ready", "True")]
OBJECTS = (
    "owner int, role string, phase string, deleted_at string, "
    "conditions array<struct<type: string, status: string>>"
)


def test_active_count(spark):
    owners = spark.createDataFrame([(1, "x"), (2, "y")], "owner int, tag string")
    objects = spark.createDataFrame(
        [
            (1, "datanode", "Failed", None, READY),
            (1, "datanode", "Running", None, READY),
            (1, "datanode", "Running", None, [("Ready", "False")]),
            (1, "datanode", "Running", "2024-01-01", READY),
            (1, "datanode", "Running", None, None),
            (1, "namenode", "Running", None, READY),
            (1, "other", "Running", None, READY),
            (9, "namenode", "Running", None, READY),
        ],
        OBJECTS,
    )
    found = replicas.active_replicas(owners, objects, ["owner"], ["namenode", "datanode"])
    assert rows(found) == [
        (1, "x", "datanode", 1),
        (1, "x", "namenode", 1),
        (2, "y", "datanode", 0),
        (2, "y", "namenode", 0),
    ]


def test_replica_status(spark):
    owners = spark.createDataFrame([(1, 2, None), (2, 0, 3)], "owner int, n int, d int")
    objects = spark.createDataFrame(
        [(1, "datanode", "Running", None, READY)] * 2 + [(1, "namenode", "Pending", None, READY)],
        OBJECTS,
    )
    found = replicas.replica_status(owners, objects, ["owner"], {"namenode": "n", "datanode": "d"})
    assert found.columns == ["owner", "n", "d", "replicas"]
    status = {r.owner: {k: tuple(v) for k, v in r.replicas.items()} for r in found.collect()}
    assert status == {
        1: {"namenode": (0, 2), "datanode": (2, None)},
        2: {"namenode": (0, 0), "datanode": (0, 3)},
    }


def test_gate_of_a_deleted_cluster(spark):
    frame = spark.createDataFrame([("2024-01-01",), (None,)], "d string").orderBy("d")
    yes, no = F.lit(True), F.lit(False)
    gate = replicas.application_open_stage(yes, no, F.lit(None), yes, F.col("d"))
    assert [r[0] for r in frame.select(gate).collect()] == [None, 1]


def test_shuffle_carries_partial_counts(spark):
    owners = spark.createDataFrame([(1,)], "owner int")
    objects = spark.createDataFrame([(1, "datanode", "Running", None, READY)], OBJECTS)
    found = replicas.active_replicas(owners, objects, ["owner"], ["datanode"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(
    ("active", "wanted", "ready"), [(0, None, False), (1, None, True), (1, 2, False), (0, 0, True)]
)
def test_replica_ready(spark, active, wanted, ready):
    frame = spark.createDataFrame([(active, wanted)], "active int, wanted int")
    expression = replicas.replica_ready(F.col("active"), F.col("wanted"))
    assert frame.select(expression).first()[0] is ready


def test_readiness_needs_all_gating_roles_and_the_config(spark):
    status = []
    for cluster, missing in ((1, None), (2, "datanode"), (3, None)):
        status += [(cluster, r, True) for r in GATING_ROLES if r != missing]
        status.append((cluster, "hbase", False))
    frame = spark.createDataFrame(status, "cluster int, role string, ready boolean")
    configs = spark.createDataFrame([(1,), (2,), (1,)], "cluster int")
    found = replicas.cluster_readiness(frame, ["cluster"], GATING_ROLES, configs)
    assert rows(found) == [
        (1, True, True, True),
        (2, False, True, False),
        (3, True, False, False),
    ]
    free = replicas.cluster_readiness(frame, ["cluster"], GATING_ROLES)
    assert [r.ready for r in free.orderBy("cluster").collect()] == [True, False, True]


def test_first_open_stage(spark):
    stages = spark.createDataFrame(
        [(1, 1, True), (1, 2, False), (1, 3, False), (2, 1, True), (3, 2, None)],
        "obj int, stage int, done boolean",
    )
    assert rows(replicas.first_open_stage(stages, ["obj"])) == [(1, 2), (2, None), (3, 2)]


@pytest.mark.parametrize(
    ("running", "loader", "phase", "driver", "expected"),
    [
        (False, False, None, False, 1),
        (True, True, None, True, 2),
        (True, True, "Running", True, 2),
        (True, True, "Succeeded", False, 3),
        (True, False, None, False, 3),
        (True, False, None, True, None),
        (None, False, None, True, 1),
    ],
)
def test_application_gate(spark, running, loader, phase, driver, expected):
    frame = spark.createDataFrame(
        [(running, loader, phase, driver)], "a boolean, b boolean, c string, d boolean"
    )
    gate = replicas.application_open_stage(*[F.col(c) for c in "abcd"])
    assert frame.select(gate).first()[0] == expected


def test_drift(spark):
    desired = spark.createDataFrame(
        [(1, None), (2, 1), (3, 2), (4, None), (5, 3)], "k int, replicas int"
    )
    observed = spark.createDataFrame(
        [(1, 1), (2, None), (3, None), (4, 2)], "k int, observed int"
    )
    found = replicas.drift(desired, observed, ["k"])
    assert rows(found) == [(1, 1, 1, False), (2, 1, 1, False), (3, 2, 1, True), (4, 1, 2, True)]


def test_missing_children(spark):
    parents = spark.createDataFrame(
        [(1, 3), (2, 0), (3, None), (4, 1)], "k int, replicas int"
    )
    children = spark.createDataFrame([(1, 1), (1, 1), (1, 7), (4, 0)], "k int, ordinal int")
    assert rows(replicas.missing_children(parents, children, ["k"])) == [(1, 0), (1, 2)]


def test_child_name(spark):
    name = replicas.child_name(F.lit("demo"), F.lit("datanode"), F.lit(3))
    assert spark.range(1).select(name).first()[0] == "demo-datanode-3"


def test_parent_of_very_many_replicas_is_expanded_by_several_tasks(spark):
    parents = spark.createDataFrame([(1, 95_000), (2, 10_000), (3, 10_001)], "k int, replicas int")
    found = replicas.expected_children(parents, ["k"])
    assert found.schema["ordinal"].dataType == parents.schema["replicas"].dataType
    summary = found.groupBy("k").agg(F.count("*"), F.count_distinct("ordinal"), F.max("ordinal"))
    assert rows(summary) == [(1, 95_000, 95_000, 94_999), (2, 10_000, 10_000, 9_999), (3, 10_001, 10_001, 10_000)]
    tasks = found.where("k = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1
