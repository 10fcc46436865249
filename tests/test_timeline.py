import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from folds import fold_conditions
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from muster.functions import conditions as conds
from muster.operators.timeline import condition_lists, condition_rows

START = datetime(2024, 1, 1)
SCHEMA = "obj int, ts timestamp, id bigint, type string, reason string, message string"


def lists(spark, reports, **options):
    frame = spark.createDataFrame(reports, SCHEMA)
    found = condition_lists(frame, ["obj"], ["ts", "id"], message="message", **options)
    return {
        r.obj: [
            (c.type, c.status, c.reason, c.last_update, c.last_transition) for c in r.conditions
        ]
        for r in found.collect()
    }


def random_log(seed, objects=12, size=1200, types=("Created", "Running", "Reconfiguring")):
    rng = random.Random(seed)
    return [
        (
            0 if i % 3 == 0 else rng.randrange(objects),
            START + timedelta(seconds=rng.randrange(400)),
            i,
            rng.choice(types),
            rng.choice(["a", "b", None]),
            f"m{i}",
        )
        for i in range(size)
    ]


def folded(reports, **options):
    by_object = {}
    for obj, ts, ident, kind, reason, _ in sorted(reports, key=lambda r: (r[1], r[2])):
        by_object.setdefault(obj, []).append((ts, kind, reason))
    return {k: fold_conditions(v, **options) for k, v in by_object.items()}


@pytest.mark.parametrize("min_rows", [5, 60, 1_000_000])
def test_equals_fold_with_and_without_slicing(spark, min_rows):
    reports = random_log(min_rows)
    assert lists(spark, reports, min_rows=min_rows) == folded(reports)


def test_application_types_remove_nothing(spark):
    reports = random_log(3, types=conds.APPLICATION_TYPES)
    found = lists(spark, reports, types=conds.APPLICATION_TYPES, reconfiguring=None)
    assert found == folded(reports, removes_running=False)


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(
            st.integers(0, 2),
            st.integers(0, 6),
            st.sampled_from(["Created", "Running", "Reconfiguring"]),
            st.sampled_from(["a", "b", None]),
        ),
        min_size=1,
        max_size=40,
    ),
    st.sampled_from([1, 3, 1000]),
)
def test_equals_fold_on_any_log(spark, log, min_rows):
    reports = [
        (obj, START + timedelta(seconds=s), i, kind, reason, "")
        for i, (obj, s, kind, reason) in enumerate(log)
    ]
    assert lists(spark, reports, min_rows=min_rows) == folded(reports)


@pytest.mark.parametrize(
    ("report", "expected"),
    [
        ("Running", {"Created": "False", "Reconfiguring": "False", "Running": "True"}),
        ("Created", {"Running": "False", "Reconfiguring": "False", "Created": "True"}),
        ("Reconfiguring", {"Created": "False", "Reconfiguring": "True"}),
    ],
)
def test_a_report_turns_the_others_off(spark, report, expected):
    history = ["Created", "Reconfiguring", "Running"]
    log = [
        (1, START + timedelta(seconds=i), i, kind, f"r{i}", "")
        for i, kind in enumerate([*history, report])
    ]
    assert {c[0]: c[1] for c in lists(spark, log)[1]} == expected


def test_repeated_report_changes_nothing(spark):
    log = [(1, START + timedelta(seconds=i), i, "Running", "same", str(i)) for i in range(4)]
    assert lists(spark, log)[1] == [("Running", "True", "same", START, START)]


def test_new_reason_keeps_the_transition(spark):
    late = START + timedelta(seconds=9)
    log = [(1, START, 0, "Running", "a", ""), (1, late, 1, "Running", "b", "")]
    assert lists(spark, log)[1] == [("Running", "True", "b", late, START)]


def test_unknown_type_is_an_error(spark):
    with pytest.raises(Exception, match="unknown condition type"):
        lists(spark, [(1, START, 0, "Sleeping", "a", "")])


def test_rows_are_numbered(spark):
    log = [(1, START, 0, "Created", "a", "x"), (1, START, 1, "Running", "b", "y")]
    frame = spark.createDataFrame(log, SCHEMA)
    found = condition_rows(
        condition_lists(frame, ["obj"], ["ts", "id"], message="message"), ["obj"]
    )
    assert rows(found.select("position", "type", "message")) == [
        (1, "Created", "x"),
        (2, "Running", "y"),
    ]


CONDITIONS = "conditions array<struct<type: string, status: string>>"


@pytest.mark.parametrize(
    ("predicate", "held", "expected"),
    [
        (conds.is_running, [("Running", "True")], True),
        (conds.is_running, [("Running", "False")], False),
        (conds.is_running, None, False),
        (conds.is_running, [], False),
        (conds.is_finished, [("Failed", "True")], True),
        (conds.is_finished, [("Succeeded", "True")], True),
        (conds.is_finished, [("Succeeded", "False"), ("Running", "True")], False),
        (conds.is_finished, None, False),
        (conds.is_created, [("Created", "True")], True),
        (conds.is_submitted, [("Submitted", "Unknown")], False),
        (conds.is_submitted, [("Submitted", None)], False),
        (conds.current_type, [("Created", "False"), ("Running", "True")], "Running"),
        (conds.current_type, [], None),
        (conds.current_type, None, None),
    ],
)
def test_predicates(spark, predicate, held, expected):
    frame = spark.createDataFrame([(held,)], CONDITIONS)
    assert frame.select(predicate(F.col("conditions"))).first()[0] == expected


def test_age(spark):
    times = [(START, START + timedelta(seconds=90.5))]
    frame = spark.createDataFrame(times, "a timestamp, b timestamp")
    assert frame.select(conds.age_seconds(F.col("a"), F.col("b"))).first()[0] == 90
