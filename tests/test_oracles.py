"""Every registered query against its SQL, on the given tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def canonical(table):
    frame = table.to_pandas()
    frame = frame[sorted(frame.columns)]
    return sorted(
        [
            tuple(None if v is None or v is pd.NaT or v != v else v for v in row)
            for row in frame.itertuples(index=False, name=None)
        ],
        key=lambda row: tuple((v is None, str(v)) for v in row),
    )


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF_DIR).toArrow()
    want = duck.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    assert canonical(got) == canonical(want)


def test_entry(spark):
    frame = registry.entry(spark)
    assert frame.columns == ["word", "n"]
    assert frame.count() > 0


FIXTURE_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("name", "expression", "expected"),
    [
        ("word_count", "count(*), sum(n)", (93796, 390171)),
        ("owner_resolution", "count(*)", (13636,)),
        (
            "active_replicas",
            "count_if(active = 0), count_if(active = 1), count_if(active = 5), max(active)",
            (24376, 14953, 22, 6),
        ),
        ("cluster_readiness", "count(*), count_if(replicas_ready)", (15000, 4398)),
        (
            "first_open_stage",
            "count_if(open_stage = 1), count_if(open_stage = 2), count_if(open_stage = 3), "
            "count_if(open_stage is null)",
            (7452, 2252, 898, 4398),
        ),
        ("condition_timeline", "count(*), count(distinct user_id)", (416, 150)),
        ("replica_drift", "count_if(drifted), count_if(not drifted)", (13779, 1221)),
        ("missing_children", "count(*), count(distinct o_orderkey)", (12635, 8533)),
        ("resource_totals", "sum(cpu_requests), sum(memory_mb)", (200, 2095104)),
        ("changed_fields", "count_if(type_changed)", (8016,)),
        ("reclaimable_clusters", "count(*)", (1326,)),
    ],
)
def test_known_totals(spark, name, expression, expected):
    found = registry.queries()[name](spark, FIXTURE_DIR)
    columns = [f"{part.strip()} as c{i}" for i, part in enumerate(_split(expression))]
    assert tuple(found.selectExpr(*columns).first()) == expected


def _split(expression):
    parts, depth = [""], 0
    for char in expression:
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += char
    return parts


def test_known_claims(spark):
    found = registry.queries()["claim_classification"](spark, FIXTURE_DIR)
    assert dict(found.groupBy("action").count().collect()) == {
        "adopt": 729,
        "owned": 4149,
        "release": 5615,
        "ignored": 1917,
        "ignored_deleting": 522,
        "ignored_foreign": 1714,
        "ignored_terminating": 354,
    }
