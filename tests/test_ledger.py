"""Changes counted once, tables written where they differ, counts and versions from a feed."""

import os
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from muster.plans.slices import with_previous
from muster.streaming import ledger
from muster.streaming.keyed import KeyedTable
from muster.streaming.versions import maintain_previous, read_previous


def arriving(spark, folder, schema, pieces, start):
    """Runs the stream once for each piece of its input."""
    for piece in pieces:
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(folder)
        start(spark.readStream.schema(schema).parquet(folder)).awaitTermination()


def forget_commit(checkpoint, number):
    """As after a crash before the last batch was marked as done."""
    for name in (f"{number}", f".{number}.crc"):
        if os.path.exists(path := f"{checkpoint}/commits/{name}"):
            os.remove(path)


def test_replays_count_once_however_late(spark, tmp_path):
    schema, path, checkpoint = "obj string, version int, v string", str(tmp_path / "t"), str(tmp_path / "c")

    def change(i):
        return (None if i % 10 == 0 else f"o{i % 4}", i, "x")

    pieces = [
        [change(i) for i in range(40)] + [change(3), change(3)],
        [change(i) for i in range(30, 60)] + [change(0)],
        [],
        [change(i) for i in range(70)],
    ]
    start = lambda s: ledger.write_once(s, ["obj", "version"], path, checkpoint, every=2)
    arriving(spark, str(tmp_path / "in"), schema, pieces, start)
    written = lambda: sorted(r.version for r in spark.read.parquet(f"{path}/rows").collect())
    assert written() == list(range(70))
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    forget_commit(checkpoint, last)
    start(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).awaitTermination()
    assert written() == list(range(70))


def test_only_differing_rows_are_written(spark, tmp_path):
    schema = "ns string, name string, status struct<phase: string, n: int>, labels map<string, string>"
    table = KeyedTable(str(tmp_path / "t"), ("ns", "name"), buckets=3, every=3)
    first = [("n", f"o{i}", ("Running", i) if i % 3 else None, {"a": "1", "b": str(i)}) for i in range(20)]
    first += [(None, "o1", ("Running", None), None)]
    write = lambda data, number: ledger.write_differing(table, spark.createDataFrame(data, schema), number)
    assert write(first, 0) == 21
    # The same, and the same with its maps written in another order.
    assert write(first, 1) == 0
    assert write([(a, b, c, dict(reversed(d.items())) if d else d) for a, b, c, d in first], 2) == 0
    changed = [("n", "o1", ("Failed", 1), {"a": "1", "b": "1"}), ("n", "o3", ("Running", 3), {"a": "1", "b": "3"}), ("n", "o4", ("Running", 4), {"a": "1", "b": "x"})]
    more = [("n", "new", None, None), (None, "o1", None, None)]
    assert write(changed + first[5:15] + more, 3) == 5
    want = {(a, b): (c, d) for a, b, c, d in first + changed + more}
    held = lambda: {(r.ns, r.name): (r.status and tuple(r.status), r.labels) for r in table.read(spark).collect()}
    assert held() == want
    # A version that was not finished is not there; writing it again is.
    write([("n", "o5", None, None)], 4)
    os.remove(f"{table.path}/delta/batch=4/_SUCCESS")
    assert held() == want
    assert write([("n", "o5", None, None)], 4) == 1
    assert held() == want | {("n", "o5"): (None, None)}


def test_counts_follow_the_feed(spark, tmp_path):
    """Births, deaths, changes of state and moves, after each batch and a batch run again."""
    rng = random.Random(3)
    schema = "old struct<owner: string, role: string, active: int>, new struct<owner: string, role: string, active: int>"
    path, checkpoint, folder = (str(tmp_path / x) for x in ("t", "c", "in"))
    keys = {c: (F.col(f"old.{c}"), F.col(f"new.{c}")) for c in ("owner", "role")}
    counts = F.col("old.active"), F.col("new.active")
    start = lambda s: ledger.keep_counts(s, keys, counts, path, checkpoint, buckets=2, every=2)
    fleet = {}
    for number in range(5):
        changes = []
        for _ in range(60):
            i = rng.randrange(40)
            old = fleet.get(i)
            new = None if rng.random() < 0.3 else (rng.choice(["hot", "hot", "o1", "o2", None]), rng.choice("ab"), rng.choice([0, 1, 1, 2, None]))
            changes.append((old, new))
            fleet[i] = new
        arriving(spark, folder, schema, [changes], start)
        want = Counter()
        for state in fleet.values():
            if state:
                want[state[:2]] += state[2] or 0
        assert {(r.owner, r.role): r.n for r in KeyedTable(path, ("owner", "role")).read(spark).collect()} == {k: n for k, n in want.items() if n}
    forget_commit(checkpoint, 4)
    start(spark.readStream.schema(schema).parquet(folder)).awaitTermination()
    assert {(r.owner, r.role): r.n for r in KeyedTable(path, ("owner", "role")).read(spark).collect()} == {k: n for k, n in want.items() if n}


@pytest.mark.parametrize("order", ["in order", "at random"])
def test_versions_equal_the_batch(spark, tmp_path, order):
    """In order, as the batches would come; at random, with late versions, ties and repeats."""
    schema = "obj int, rv bigint, id int, v string, labels map<string, string>"
    rng = random.Random(order)
    data = [(rng.choice([7, 7, rng.randrange(9), None]), i // 3, i, rng.choice("xyz"), {"a": rng.choice("12")}) for i in range(240)]
    dealt = list(data) if order == "in order" else rng.sample(data, len(data))
    pieces = [dealt[i * 60 : (i + 1) * 60] for i in range(4)]
    if order == "at random":
        pieces[2] += pieces[0][:9] + pieces[2][:2]
    path, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    keys, by, columns = ["obj"], ["rv", "id"], ["v", "labels"]
    start = lambda s: maintain_previous(s, keys, by, columns, path, checkpoint, min_rows=10, buckets=3, every=2)
    arriving(spark, str(tmp_path / "in"), schema, pieces, start)
    plain = lambda f: rows(f.select("obj", "rv", "id", "v", "prev.v", "prev.labels"))
    want = with_previous(spark.createDataFrame(data, schema), keys, by, columns)
    assert plain(read_previous(spark, path, keys, by)) == plain(want)
