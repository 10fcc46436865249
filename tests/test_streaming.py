import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from folds import fold_conditions

from muster.operators.changes import owners_to_revisit
from muster.streaming import feed as feeds
from muster.streaming import timeline as streams
from muster.streaming.keyed import KeyedTable

START = datetime(2024, 1, 1)
SCHEMA = "obj bigint, ts timestamp, id bigint, type string, reason string, message string"


def reports(seed, size):
    rng = random.Random(seed)
    return [
        (
            7 if i % 3 == 0 else rng.randrange(20),
            START + timedelta(seconds=i // 3),
            i,
            rng.choice(["Created", "Running", "Reconfiguring"]),
            rng.choice(["a", "b", None]),
            f"m{i}",
        )
        for i in range(size)
    ]


def write_file(spark, folder, number, data, schema):
    """One more feed file; files are read in the order of their modification time."""
    import os
    import time

    shuffled = random.Random(number).sample(data, len(data))
    path = f"{folder}/file-{number}"
    spark.createDataFrame(shuffled, schema).coalesce(1).write.parquet(path)
    (part,) = [f for f in os.listdir(path) if f.endswith(".parquet")]
    stamp = time.time() - 1000 + number
    os.utime(f"{path}/{part}", (stamp, stamp))


def folded(data):
    logs = {}
    for obj, ts, _, kind, reason, _ in sorted(data, key=lambda r: (r[1], r[2])):
        logs.setdefault(obj, []).append((ts, kind, reason))
    return {obj: fold_conditions(log) for obj, log in logs.items()}


def run(spark, source, work, min_rows=10, every=16):
    """Keeps the lists over what has arrived, a file per micro-batch."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    streams.maintain_conditions(
        stream, ["obj"], ["ts", "id"], work, f"{work}/checkpoint", message="message",
        min_rows=min_rows, buckets=4, every=every,
    ).awaitTermination()
    return streams.current_conditions(spark, work, ["obj"])


def as_dict(lists):
    return {
        r.obj: [
            (c.type, c.status, c.reason, c.last_update, c.last_transition) for c in r.conditions
        ]
        for r in lists.collect()
    }


def arrive(spark, folder, files):
    for i, data in enumerate(files):
        write_file(spark, folder, i, data, SCHEMA)


def at(obj, minute, number, kind, reason="a"):
    return (obj, START + timedelta(minutes=minute), number, kind, reason, "m")


LATE = {
    # A void report is the newest: what lies before it is late all the same.
    "void": [[at(1, 1, 1, "Running"), at(1, 5, 2, "Running")], [at(1, 3, 3, "Created")]],
    # At one instant the smaller id comes first.
    "tie": [[at(1, 1, 9, "Created")], [at(1, 1, 3, "Running")]],
    "before all": [[at(1, 5, 1, "Running")], [at(1, 1, 2, "Running"), at(1, 2, 3, "Reconfiguring")]],
    "between": [[at(1, 1, 1, "Running"), at(1, 9, 2, "Created")], [at(1, 4, 3, "Reconfiguring")], [at(1, 10, 4, "Created", "b")]],
    "late twice": [[at(1, 9, 1, "Running")], [at(1, 5, 2, "Created")], [at(1, 3, 3, "Running")], [at(1, 11, 4, "Running")]],
    "late and not": [[at(1, 9, 1, "Running"), at(2, 1, 1, "Created")], [at(1, 5, 2, "Running"), at(2, 2, 2, "Created")]],
    "again": [[at(1, 1, 1, "Running"), at(1, 2, 2, "Created")], [at(1, 1, 1, "Running")], [at(1, 2, 2, "Created"), at(1, 3, 3, "Running")]],
    "no reason": [[at(1, 1, 1, "Running", None)], [at(1, 2, 2, "Running", None), at(1, 3, 3, "Running", "")]],
}


def test_late_reports_give_the_fold(spark, tmp_path):
    """All cases at once, each with objects of its own."""
    source, files = str(tmp_path / "in"), [[] for _ in range(4)]
    for case, given in enumerate(LATE.values()):
        for number, reports_ in enumerate(given):
            files[number] += [(10 * case + obj, *rest) for obj, *rest in reports_]
    arrive(spark, source, files)
    got = as_dict(run(spark, source, str(tmp_path / "work")))
    for case, (name, given) in enumerate(LATE.items()):
        want = folded({r for f in given for r in f})
        assert {obj: got[10 * case + obj] for obj in want} == want, name


@pytest.mark.parametrize("seed", [1, 2])
def test_files_in_any_order_give_the_fold(spark, tmp_path, seed):
    """Reports dealt to files at random, a hot object sliced, one base on the way."""
    data = reports(seed, 400)
    rng = random.Random(seed)
    files = [[] for _ in range(5)]
    for r in data:
        files[rng.randrange(5)].append(r)
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    arrive(spark, source, files)
    assert as_dict(run(spark, source, work, every=2)) == folded(data)


def test_batches_and_a_restart_give_the_fold(spark, tmp_path):
    """Rows are out of order within each file; the stream is started anew halfway."""
    data = reports(5, 600)
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    for files in (range(3), range(3, 6)):
        for i in files:
            write_file(spark, source, i, data[i * 100 : (i + 1) * 100], SCHEMA)
        lists = run(spark, source, work)
    assert as_dict(lists) == folded(data)


def test_a_batch_run_again_counts_once(spark, tmp_path):
    """The last batch is run again after its table was written, as after a crash before its commit."""
    import glob
    import os

    data = reports(9, 300)
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    arrive(spark, source, [data[i * 100 : (i + 1) * 100] for i in range(3)])
    want = as_dict(run(spark, source, work, every=2))
    for name in glob.glob(f"{work}/checkpoint/commits/*2") + glob.glob(f"{work}/checkpoint/commits/.2.crc"):
        os.remove(name)
    assert as_dict(run(spark, source, work, every=2)) == want == folded(data)


def test_unknown_type_stops_the_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    write_file(spark, source, 0, [(1, START, 0, "Sleeping", "a", "")], SCHEMA)
    with pytest.raises(Exception, match="unknown condition type"):
        run(spark, source, str(tmp_path / "work"))


def test_a_keyed_table_reads_few_folders(spark, tmp_path):
    """After any number of batches: one base and fewer deltas than make a new one."""
    table = KeyedTable(str(tmp_path / "table"), ["k"], buckets=2, every=4)
    want = {}
    for batch in range(23):
        new = {k: (batch, k % 5 == batch % 5) for k in range(batch, batch + 6)}
        want = {k: v for k, v in {**want, **{k: b for k, (b, _) in new.items()}}.items() if not new.get(k, (0, False))[1]}
        rows_ = [(k, b, gone) for k, (b, gone) in new.items()]
        table.write(spark.createDataFrame(rows_, "k int, v int, _gone boolean"), batch)
        table.compact(spark, batch)
        assert len(table._folders(spark, None)) <= 5
        if batch % 6 == 0:
            assert {r.k: r.v for r in table.read(spark).collect()} == want
    assert len(table._batches(spark, "base")) <= 2 and len(table._batches(spark, "delta")) <= 8
    assert {r.k: r.v for b in (0, 1) for r in table.read(spark, buckets=[b]).collect()} == want


FEED = (
    "id bigint, ts timestamp, namespace string, "
    "new_owner struct<kind: string, name: string, uid: string, controller: boolean>"
)


def test_replays_are_dropped_and_owners_collected(spark, rocks, tmp_path):
    def change(i):
        owner = ("Cluster", f"c{i % 4}", "u", i % 4 != 3)
        return (i, START + timedelta(seconds=i), "ns", owner)

    source = str(tmp_path / "in")
    write_file(spark, source, 0, [change(i) for i in range(40)], FEED)
    write_file(spark, source, 1, [change(i) for i in range(20, 60)], FEED)

    def stream():
        frame = (
            rocks.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        )
        return feeds.without_replays(frame, ["id"], "ts")

    once = str(tmp_path / "once")
    feeds.write_batches(stream(), once, str(tmp_path / "c1"), mode="append").awaitTermination()
    kept = feeds.read_batches(rocks, once, FEED)
    assert sorted(r.id for r in kept.collect()) == list(range(60))

    routed = str(tmp_path / "routed")
    keys = ["namespace", "new_owner.name"]
    feeds.write_owners_to_revisit(
        stream(), keys, routed, str(tmp_path / "c2")
    ).awaitTermination()
    found = feeds.read_batches(rocks, routed, "namespace string, name string")
    assert rows(found.select("namespace", "name").distinct()) == [
        ("ns", "c0"),
        ("ns", "c1"),
        ("ns", "c2"),
    ]
    batch = spark.createDataFrame([change(i) for i in range(40)], FEED)
    assert owners_to_revisit(batch, keys).count() == 3


def test_read_feed_bounds_its_batches(rocks, spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).repartition(4).write.parquet(source)
    stream = feeds.read_feed(rocks, source, "id bigint", pattern="*.parquet", max_bytes=1)
    target = str(tmp_path / "out")
    feeds.write_batches(stream, target, str(tmp_path / "c"), mode="append").awaitTermination()
    found = feeds.read_batches(rocks, target, "id bigint")
    assert found.count() == 10
    assert found.select("batch").distinct().count() == 4
