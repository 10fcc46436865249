import itertools

from conftest import rows
from pyspark.sql import functions as F

from muster.operators import changes
from muster.operators.lifecycle import lifecycles, phase_condition

OWNER = "struct<kind: string, name: string, uid: string, controller: boolean>"
FEED = (
    "id int, op string, kind string, namespace string, name string, role string, "
    f"rv_old bigint, rv_new bigint, old_owner {OWNER}, new_owner {OWNER}"
)
OWNERS = [("Cluster", "ns", "a", "u1"), ("Cluster", "ns", "b", "u2"), ("App", "ns", "a", "u3")]
REFS = [
    None,
    ("Cluster", "a", "u1", True),
    ("Cluster", "a", "gone", True),
    ("Cluster", "b", "u2", True),
    ("App", "a", "u3", True),
    ("Cluster", "a", "u1", False),
]


def owners(spark):
    return spark.createDataFrame(OWNERS, "kind string, namespace string, name string, uid string")


def resolves(ref):
    return ref is not None and (ref[0], "ns", ref[1], ref[2]) in OWNERS


def wants_update(kind, rv_old, rv_new, old, new):
    """The update rule, one row at a time."""
    old = old if old and old[3] else None
    new = new if new and new[3] else None
    if rv_old == rv_new or (old is None and new is None) or kind not in changes.UPDATE_KINDS:
        return False
    if old is not None and old != new:
        owner_kind = new[0] if new else old[0]
        if old[0] == owner_kind and resolves(old):
            return True
    return resolves(new)


def test_updates_match_the_rule(spark):
    cases = [
        (i, "update", kind, "ns", "o", "", rv, 2, old, new)
        for i, (kind, rv, old, new) in enumerate(
            itertools.product(("Pod", "Cluster", "Secret"), (1, 2), REFS, REFS)
        )
    ]
    feed = spark.createDataFrame(cases, FEED)
    found = changes.relevant_updates(feed, owners(spark))
    assert found.columns == feed.columns
    expected = [(c[0],) for c in cases if wants_update(c[2], c[6], c[7], c[8], c[9])]
    assert 0 < len(expected) < len(cases)
    assert rows(found.select("id")) == sorted(expected, key=repr)


def test_births_and_deaths(spark):
    ref, loose = REFS[1], REFS[5]
    cases = [
        (1, "create", "Pod", "ns", "o", "driver", None, 1, None, ref),
        (2, "create", "Pod", "ns", "o", "", None, 1, None, ref),
        (3, "create", "Secret", "ns", "o", "driver", None, 1, None, ref),
        (4, "create", "Secret", "ns", "o", "driver", None, 1, None, None),
        (5, "delete", "Secret", "ns", "o", "driver", 1, None, ref, None),
        (6, "delete", "Service", "ns", "o", "driver", 1, None, ref, None),
        (7, "delete", "Service", "ns", "o", None, 1, None, ref, None),
        (8, "create", "Secret", "ns", "o", "driver", None, 1, None, loose),
        (9, "resync", "Pod", "ns", "o", "driver", 1, 2, ref, ref),
    ]
    feed = spark.createDataFrame(cases, FEED)
    found = changes.relevant_changes(feed, owners(spark))
    assert rows(found.select("id")) == [(1,), (4,), (6,), (8,)]


def test_changed_is_null_safe_and_compares_maps(spark):
    frame = spark.createDataFrame(
        [
            (1, {"a": "1", "b": "2"}, {"b": "2", "a": "1"}, "x", "x"),
            (2, {"a": "1"}, {"a": "2"}, None, None),
            (3, None, {}, None, "y"),
        ],
        "id int, m map<string, string>, n map<string, string>, o string, p string",
    )
    both = {"labels": ("m", "n"), "name": ("o", "p")}
    found = frame.select("id", changes.changed_fields(frame, both).alias("f")).orderBy("id")
    assert [r.f for r in found.collect()] == [[], ["labels"], ["labels", "name"]]
    flag = changes.changed(frame, {"m": "n", "o": "p"})
    assert [r[0] for r in frame.orderBy("id").select(flag).collect()] == [False, True, True]


def test_owners_to_revisit(spark):
    cases = [
        (i, "update", "Pod", "ns", "o", "", 1, 2, None, ref) for i, ref in enumerate(REFS * 3)
    ]
    feed = spark.createDataFrame(cases, FEED)
    keys = ["namespace", "new_owner.kind", "new_owner.name"]
    found = changes.owners_to_revisit(feed, keys)
    assert rows(found) == [("ns", "App", "a"), ("ns", "Cluster", "a"), ("ns", "Cluster", "b")]
    assert rows(changes.owners_to_revisit(feed, keys, kind="App")) == [("ns", "App", "a")]
    assert "HashAggregate" in found._jdf.queryExecution().executedPlan().toString()


def test_lifecycles(spark):
    log = [
        ("done", "2024-01-01 00:00:00", "Pending", None),
        ("done", "2024-01-01 00:00:05", "Running", True),
        ("done", "2024-01-01 00:00:09", "Succeeded", None),
        ("done", "2024-01-01 00:00:11", "Failed", None),
        ("started", "2024-01-01 00:00:00", "Running", False),
        ("started", "2024-01-01 00:00:02", "Running", True),
        ("unready", "2024-01-01 00:00:00", "Running", None),
        ("late", "2024-01-01 00:00:00", "Failed", None),
        ("late", "2024-01-01 00:00:01", "Running", True),
    ]
    frame = spark.createDataFrame(log, "app string, t string, phase string, ready boolean")
    frame = frame.withColumn("ts", F.to_timestamp("t"))
    found = lifecycles(frame, ["app"], ["ts"]).orderBy("app")
    assert [
        (r.app, r.state, r.running_time and r.running_time.second, r.seconds)
        for r in found.collect()
    ] == [
        ("done", "Succeeded", 5, 9),
        ("late", "Failed", None, 0),
        ("started", "Running", 2, None),
        ("unready", "Created", None, None),
    ]


def test_phase_condition(spark):
    cases = [
        ("Running", True, False, "Running"),
        ("Running", True, True, None),
        ("Running", False, False, None),
        ("Running", None, False, None),
        ("Succeeded", None, True, "Succeeded"),
        ("Failed", None, False, "Failed"),
        ("Pending", None, False, None),
    ]
    frame = spark.createDataFrame(cases, "p string, r boolean, a boolean, expected string")
    found = frame.select(phase_condition(F.col("p"), F.col("r"), F.col("a")), "expected")
    assert all(r[0] == r[1] for r in found.collect())


def test_lifecycle_ties_and_plan(spark):
    """Equal times are settled by the id, negative ones included; nothing is sorted."""
    log = [("a", 5, "Failed"), ("a", -7, "Succeeded"), ("b", 2, "Failed"), ("b", 1, "Running"), ("c", 1, "Failed"), ("c", 2, "Running")]
    frame = spark.createDataFrame(log, "app string, id bigint, phase string")
    frame = frame.selectExpr("*", "true as ready", "timestamp'2024-01-01' as ts")
    found = lifecycles(frame, ["app"], ["ts", "id"])
    states = [(r.app, r.state, r.running_time is not None) for r in found.orderBy("app").collect()]
    assert states == [("a", "Succeeded", False), ("b", "Failed", True), ("c", "Failed", False)]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
