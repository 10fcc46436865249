"""Selectors against labels, and claims, by a look at every object and owner."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from muster.operators.claims import adopters, candidate_claims
from muster.plans import containment

OBJECTS = "ns string, name int, labels map<string,string>, ref_uid string, terminating boolean, owner int"
OWNERS = "ns string, uid string, selector map<string,string>, deleting boolean, object string"


def fleet(seed, n_objects=120, n_owners=40):
    rng = random.Random(seed)

    def some(most, least=0):
        return {k: rng.choice("xy") for k in rng.sample("abcd", rng.randrange(least, most))}

    objects = [
        (rng.choice(["n", "m", "k"]), i, rng.choice([None, {"hot": "1"} | some(5)]) if i % 9 == 0 else {"hot": "1"} | some(5),
         rng.choice([None, None, "u1", "u2", "gone"]), rng.random() < 0.2, i)
        for i in range(n_objects)
    ]
    owners = [
        (rng.choice(["n", "m", None]), f"u{i}", rng.choice([None, {"a": None}, some(5, 3), some(5, 3), some(4, 2)]),
         rng.random() < 0.2, "clash")
        for i in range(n_owners)
    ]
    owners[1] = ("n", "u1", {"hot": "1"}, False, "clash")
    owners += [("k", f"k{i}", {"hot": "1"} if i % 2 else {}, i == 3, "clash") for i in range(4)]
    return objects, owners


def takes(selector, labels):
    return selector is not None and all(v is not None and (labels or {}).get(k) == v for k, v in selector.items())


def plain(objects, owners):
    out = []
    for ns, name, labels, ref, terminating, _ in objects:
        for scope, uid, selector, deleting, _ in owners:
            match = takes(selector, labels)
            if scope != ns or not (match or ref == uid):
                continue
            if ref is not None:
                action = "ignored_foreign" if ref != uid else "owned" if match else "ignored_deleting" if deleting else "release"
            else:
                action = "ignored" if deleting else "ignored_terminating" if terminating else "adopt"
            out.append((name, uid, action))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part", [containment.PART, 7])
def test_claims_of_every_owner(spark, part):
    objects, owners = fleet(part)
    frames = spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(owners, OWNERS)
    claims = candidate_claims(*frames, ["ns"], ["name"], part=part)
    want = plain(objects, owners)
    assert rows(claims.select("object.name", "owner.uid", "action")) == want
    assert {a for _, _, a in want} >= {"adopt", "ignored", "ignored_terminating", "ignored_foreign", "owned", "release"}
    found = {r.name: (r.candidates, r.adopter) for r in adopters(claims, frames[0], ["name"]).collect()}
    for _, name, _, ref, _, _ in objects:
        wanted = [uid for n, uid, a in want if n == name and a == "adopt"]
        assert (name in found) == (ref is None)
        if ref is None:
            assert found[name] == (len(wanted), min(wanted, default=None))
    assert {min(n, 2) for n, _ in found.values()} == {0, 1, 2}


def test_pairs_are_not_confused(spark):
    """Keys and values that run into each other are pairs of their own."""
    objects = [("n", 1, {"a": "b=c", "1:a": "x"}, None, False, 0), ("n", 2, {"a=b": "c"}, None, False, 0), ("n", 3, {"*": ""}, None, False, 0)]
    owners = [("n", "u", {"a": "b=c"}, False, ""), ("n", "v", {"a=b": "c"}, False, ""), ("n", "w", {"*": ""}, False, "")]
    found = containment.satisfied(
        spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(owners, OWNERS), ["ns"], ["name"], ["uid"]
    )
    assert rows(found.select("object.name", "owner.uid")) == [(1, "u"), (2, "v"), (3, "w")]


def test_an_object_meets_few_selectors(spark):
    """Under the rarest pair: selectors that share a hot pair don't meet its objects."""
    objects = [("n", i, {"hot": "1", "id": str(i)}, None, False, 0) for i in range(400)]
    owners = [("n", f"u{i}", {"hot": "1", "id": str(i)}, False, "") for i in range(100)]
    frames = spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(owners, OWNERS)
    found = containment.satisfied(*frames, ["ns"], ["name"], ["uid"], part=10)
    assert found.count() == 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    at = F.col("object.name").cast("string")
    assert found.where(at == F.col("owner.selector")["id"]).count() == 100


def test_empty_tables(spark):
    objects, owners = fleet(1)
    frames = spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(owners, OWNERS)
    assert candidate_claims(frames[0].limit(0), frames[1], ["ns"], ["name"]).count() == 0
    claims = candidate_claims(frames[0], frames[1].limit(0), ["ns"], ["name"])
    assert claims.count() == 0
    assert {tuple(r)[1:] for r in adopters(claims, frames[0], ["name"]).collect()} == {(0, None)}
