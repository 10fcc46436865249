"""Conversation repair: the cheapest edits that make turns alternate, and the least audit of them.

Rows of a conversation are kept, given another role, deleted, or preceded by an inserted
one, until their role initials read (s?(ua)+)?. A dynamic program over the four states of
that pattern keeps, for every row and state, the cheapest way there, of equally cheap ones
that whose audit (the edits' initials) is least.

Audits are persistent: a way is a node that names the edit of the last row and the node
before it, so that ways share their beginnings. Each node holds a rolling hash of its
audit and its ancestors at distances of powers of two. Two audits of one length are compared
by a search for their longest common prefix: jump to the earliest pair of ancestors whose
hashes differ, and compare the edits there. Equal hashes are verified edit by edit up to
the node that both share.

A row's edit is one symbol, with an insertion before it: D, IK, IR, K or R. None begins
another, so audits of the same rows are in the order of their symbols, and an insertion
directly before a deletion never belongs to a least audit (DI costs what ID does).

Ways combine: the cheapest ways through a stretch of rows from every state to every state
are a table of 16, and a conversation's are found from those of its stretches by the same
program. A conversation of any length is therefore cut into stretches that different tasks
work on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.common import written

#: Rows and characters of a stretch at most, but for a single row that is longer.
STRETCH, CHARS = 1024, 1 << 18
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The symbols of a row's edit, in ASCII order.
SYMBOLS = ("D", "IK", "IR", "K", "R")
_D, _IK, _IR, _K, _R = range(5)
#: The state after one more row of the pattern that isn't a system row.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
_PRIME, _BASE = (1 << 61) - 1, 1_000_003 * 7 + 2
#: White space, as a word in this package ends at.
SPACE = " \t\n\x0b\x0c\r"


class Audits:
    """Persistent sequences of symbols. Node 0 is the empty one."""

    def __init__(self):
        self.parent, self.symbol, self.hash, self.jump = [0], [-1], [0], [[]]

    def add(self, node: int, symbol: int) -> int:
        """The sequence of `node` and one more symbol."""
        self.parent.append(node)
        self.symbol.append(symbol)
        self.hash.append((self.hash[node] * _BASE + symbol + 1) % _PRIME)
        jump, k = [node], 0
        while k < len(self.jump[jump[k]]):
            jump.append(self.jump[jump[k]][k])
            k += 1
        self.jump.append(jump)
        return len(self.parent) - 1

    def same(self, a: int, b: int) -> bool:
        """Whether two sequences of one length are equal: by hash, then symbol by symbol."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.symbol[a] != self.symbol[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether sequence a comes before b, of the same length."""
        if self.same(a, b):
            return False
        for k in range(len(self.jump[a]) - 1, -1, -1):
            if k < len(self.jump[a]) and not self.same(x := self.jump[a][k], y := self.jump[b][k]):
                a, b = x, y
        return self.symbol[a] < self.symbol[b]

    def symbols(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.symbol[node])
            node = self.parent[node]
        return out[::-1]


def better(audits: Audits, old: tuple | None, cost: int, node: int, symbol: int) -> bool:
    """Whether cost and then node plus symbol come before old (cost, node, symbol)."""
    if old is None or cost != old[0]:
        return old is None or cost < old[0]
    if node == old[1]:
        return symbol < old[2]
    return audits.less(node, old[1]) if not audits.same(node, old[1]) else symbol < old[2]


def row_edits(initial: str, truncated: bool) -> list[tuple[int, int, int, int]]:
    """The edits of a row that may stay: (state before, cost, symbol, state after)."""
    out, extra = [], TRUNCATED * truncated
    for state in range(4):
        out.append((state, DELETE, _D, state))
        if initial == "s" and state == START:
            out.append((state, extra, _K, SYSTEM))
        # Two insertions in a row lead nowhere that none does.
        for at, keep, relabel, cost in ((state, _K, _R, extra), (NEXT[state], _IK, _IR, extra + INSERT)):
            after = NEXT[at]
            out.append((state, cost + RELABEL, relabel, after))
            if initial == ("u" if after == USER else "a"):
                out.append((state, cost, keep, after))
    return out


EDITS = {(i, t): row_edits(i, t) for i in ("s", "u", "a", "") for t in (False, True)}


def ways(rows: list[tuple], entry: int) -> list[tuple[int, str] | None]:
    """Cost and audit of the best way through rows from a state to each state.

    rows: (initial, text fit to stay, truncated, copies of which all but the first must go).
    """
    audits = Audits()
    now: dict[int, tuple[int, int]] = {entry: (0, 0)}
    forced = 0
    for initial, stays, truncated, copies in rows:
        forced += DELETE * (copies - 1 if stays else copies)
        if not stays:
            continue
        found: dict[int, tuple] = {}
        for state, cost, symbol, after in EDITS[initial if initial in ("s", "u", "a") else "", truncated]:
            if state in now:
                total, node = now[state][0] + cost, now[state][1]
                if better(audits, found.get(after), total, node, symbol):
                    found[after] = (total, node, symbol)
        now = {state: (cost, audits.add(node, symbol)) for state, (cost, node, symbol) in found.items()}
    out: list[tuple[int, str] | None] = []
    for state in range(4):
        if state not in now:
            out.append(None)
            continue
        symbols, parts = iter(audits.symbols(now[state][1])), []
        for _, stays, _, copies in rows:
            parts.append(SYMBOLS[next(symbols)] + "D" * (copies - 1) if stays else "D" * copies)
        out.append((now[state][0] + forced, "".join(parts)))
    return out


#: How a conversation may end in each state: the insertions that remain.
ENDING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


def through(stretches: list[tuple[list, list]]) -> tuple[int, list[tuple[int, int]], int]:
    """Best way through a conversation's stretches, each (costs, ranks) of 16 ways or -1.

    ranks are the places of a stretch's audits in their order. Returns the cost, the states
    before and after each stretch, and the insertions at the end.
    """
    audits, steps = Audits(), {}
    now: dict[int, tuple[int, int]] = {START: (0, 0)}
    for costs, ranks in stretches:
        found: dict[int, tuple] = {}
        for entry, (total, node) in now.items():
            for after in range(4):
                i = entry * 4 + after
                if costs[i] >= 0 and better(audits, found.get(after), total + costs[i], node, ranks[i]):
                    found[after] = (total + costs[i], node, ranks[i], entry)
        now = {}
        for after, (cost, node, rank, entry) in found.items():
            now[after] = (cost, audits.add(node, rank))
            steps[now[after][1]] = (entry, after)
    best = None
    for state, (cost, node) in now.items():
        # Ways to different states differ in some row, so what is inserted last decides nothing.
        cost += INSERT * ENDING[state]
        if best is None or cost < best[0] or cost == best[0] and audits.less(node, best[1]):
            best = (cost, node, ENDING[state])
    path, node = [], best[1]
    while node:
        path.append(steps[node])
        node = audits.parent[node]
    return best[0], path[::-1], best[2]


def repaired(rows: list[tuple[str, str, int]], audit: str, state: int) -> list[tuple[str, str]]:
    """(role, text) of what an audit makes of rows (role, text, copies) from a state on."""
    out, edits = [], iter(audit)
    for role, text, copies in rows:
        for _ in range(copies):
            edit = next(edits)
            if edit == "I":
                state = NEXT[state]
                out.append((ROLE[state], ""))
                edit = next(edits)
            if edit == "D":
                continue
            state = SYSTEM if edit == "K" and role[:1] == "s" else NEXT[state]
            out.append((role if edit == "K" else ROLE[state], text))
    return out


def ending(state: int, n: int) -> list[tuple[str, str]]:
    """The n rows inserted at the end of a conversation."""
    out = []
    for _ in range(n):
        state = NEXT[state]
        out.append((ROLE[state], ""))
    return out


LEGAL = {"su", "ua", "au"}

#: Of a stretch: what must be known of all of a conversation's before one can be mended.
LIGHT = (
    "conv_id long, heavy int, part int, place int, costs array<long>, ranks array<int>, turns array<long>, "
    "counts array<long>, initials array<string>"
)
HEAVY = "audits array<string>, roles array<string>, texts array<string>, copies array<long>"
STRETCHES = f"{LIGHT}, {HEAVY}"


def stretch(conv_id: int | None, part: int, place: int, rows: list[tuple], first: bool) -> dict:
    """A stretch's row of STRETCHES, from rows (turn, role, text, copies, repeated).

    first: it begins a conversation, so that it can only be entered at the start.
    """
    counts, units = [0, 0, 0, 0], []
    for i, (_, role, text, copies, repeated) in enumerate(rows):
        tail = text.rstrip(SPACE)
        blank, truncated = not tail, bool(tail) and tail[-1] not in ".!?"
        stays = not blank and not repeated
        counts[0] += copies if blank else 0
        counts[1] += 0 if blank else copies - (not repeated)
        counts[2] += stays and truncated
        initial = role[:1]
        counts[3] += copies - 1  # no initial may stand beside itself
        counts[3] += i > 0 and rows[i - 1][1][:1] + initial not in LEGAL
        units.append((initial, stays, truncated, copies))
    found = [w for entry in range(4) for w in (ways(units, entry) if entry == START or not first else [None] * 4)]
    order = {audit: i for i, audit in enumerate(sorted({w[1] for w in found if w}))}
    turns = [r[0] for r in rows if r[0] is not None]
    return {
        "conv_id": conv_id,
        "heavy": 0,
        "part": part,
        "place": place,
        "costs": [w[0] if w else -1 for w in found],
        "ranks": [order[w[1]] if w else -1 for w in found],
        "turns": [turns[0], turns[-1], len(set(turns))] if turns else [],
        "counts": counts,
        "initials": [rows[0][1][:1], rows[-1][1][:1]],
        "audits": [w[1] if w else None for w in found],
        "roles": [r[1] for r in rows],
        "texts": [r[2] for r in rows],
        "copies": [r[3] for r in rows],
    }


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    return pa.schema([(f.name, _arrow(f.dataType)) for f in spark.createDataFrame([], ddl).schema])


def _arrow(kind) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    if kind.typeName() == "array":
        return pa.list_(_arrow(kind.elementType))
    if kind.typeName() == "struct":
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return plain[kind.simpleString()]


def cut(schema: pa.Schema):
    """For mapInArrow over whole runs of rows in order: stretches, each row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows, chars, conv, place, first, out, held = [], 0, None, 0, False, [], 0
        started = False
        for batch in batches:
            for conv_id, turn, role, text, copies, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = not started or conv_id != conv
                if rows and (new or len(rows) >= STRETCH or chars + len(text) > CHARS):
                    out.append(stretch(conv, part, place, rows, first))
                    held += chars
                    rows, chars, place, first = [], 0, place + 1, False
                if new:
                    # What a task meets first may go on from the task before it.
                    conv, first, started = conv_id, started, True
                rows.append((turn, role, text, copies, repeated))
                chars += len(text)
                if held > 8 * CHARS or len(out) > 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        if rows:
            out.append(stretch(conv, part, place, rows, first))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


RESULT = (
    "conv_id long, piece int, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string, rows array<struct<role: string, text: string>>"
)


def mend(schema: pa.Schema):
    """For mapInArrow over a conversation's light rows and then its heavy ones, in order.

    A task holds a conversation's light rows, its audit and one stretch; its text streams
    through the hash.
    """

    def whole(conv_id: int | None, lights: list[dict]) -> dict:
        """What the light rows say of a conversation."""
        counts = [sum(x["counts"][i] for x in lights) for i in range(4)]
        for a, b in zip(lights[:-1], lights[1:], strict=True):
            counts[3] += a["initials"][1] + b["initials"][0] not in LEGAL
        turns = [x["turns"] for x in lights if x["turns"]]
        distinct = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns[:-1], turns[1:], strict=True))
        gaps = turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0
        cost, path, inserted = through([(x["costs"], x["ranks"]) for x in lights])
        names = ("blank", "duplicate", "truncated", "illegal")
        said = {"conv_id": conv_id, "gaps": min(gaps, (1 << 63) - 1), "cost": cost, **dict(zip(names, counts, strict=True))}
        return {"said": said, "path": path, "inserted": inserted, "audit": [], "sha": hashlib.sha256(), "lines": 0, "piece": 0}

    def hashed(state: dict, rows: list[tuple[str, str]]) -> None:
        for role, text in rows:
            line = f"{role}:{text}" if not state["lines"] else f"\n{role}:{text}"
            state["sha"].update(line.encode("utf-8", "replace"))
            state["lines"] += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lights, state, begun = None, [], None, False

        def piece(conv_id: int | None, i: int, last: bool, rows: list[tuple[str, str]]) -> dict:
            return {"conv_id": conv_id, "piece": i, "last": last, "rows": [{"role": r, "text": t} for r, t in rows]}

        def finish() -> list[dict]:
            """The last piece of the conversation read so far: what is inserted at its end."""
            if not begun:
                return []
            made = state or whole(now, lights)
            rows = ending(made["path"][-1][1] if made["path"] else START, made["inserted"])
            hashed(made, rows)
            audit = "".join(made["audit"]) + "I" * made["inserted"]
            found = {"audit": audit, "repaired_sha256": made["sha"].hexdigest()}
            return [piece(now, made["piece"], True, rows) | made["said"] | found]

        out, held = [], 0
        for batch in batches:
            for i in range(len(batch)):
                conv_id, heavy = batch["conv_id"][i].as_py(), batch["heavy"][i].as_py()
                if not begun or conv_id != now:
                    out.extend(finish())
                    now, lights, state, begun = conv_id, [], None, True
                if heavy == 0:
                    lights.append({n: batch[n][i].as_py() for n in ("costs", "ranks", "turns", "counts", "initials")})
                elif heavy > 0:
                    state = state or whole(now, lights)
                    x = {n: batch[n][i].as_py() for n in ("audits", "roles", "texts", "copies")}
                    entry, after = state["path"][state["piece"]]
                    audit = x["audits"][entry * 4 + after]
                    rows = repaired(list(zip(x["roles"], x["texts"], x["copies"], strict=True)), audit, entry)
                    state["audit"].append(audit)
                    hashed(state, rows)
                    out.append(piece(now, state["piece"], False, rows))
                    state["piece"] += 1
                    held += sum(map(len, x["texts"]))
                if held > 8 * CHARS or len(out) > 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        out.extend(finish())
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def repair(spark: SparkSession, rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Pieces of repaired conversations, in the order of `piece` within a conv_id.

    rows(conv_id, turn, role, text); a null role or text is one space. ids(conv_id):
    conversations that get a row though they have none here.

    A piece holds `rows`, an array of (role, text); the last one of a conversation also
    gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, which are null
    in the others. A conversation's rows stand in the order of turn (nulls first), role
    and text; rows equal in all of these are duplicates of the first. A role without
    a first letter s, u or a, an empty one too, cannot be kept. Rows of a null conv_id are a
    conversation. gaps beyond 2**63 - 1 is that. A conversation without rows has zeros, an
    empty audit and the hash of nothing. No rows give no rows; extra columns are not looked at.

    Equal rows are one row with a number of copies before anything is sorted, and earlier
    rows of a role and text are found by aggregation, so that neither a repeated row nor
    a repeated text meets in one task. Rows are then sorted as a whole: each task
    gets a run of them, and cuts it into stretches of STRETCH rows or CHARS characters.
    A conversation may span any number of tasks. In the end its stretches' tables of 16 ways
    meet (a row for each), and its texts stream through the hash, which has to read them in
    order: only that takes as long as the longest conversation. A text is held whole.
    """
    fixed = rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    units = fixed.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    units = written(spark, units.withColumn("digest", digest), "units")
    seen = units.groupBy("conv_id", "digest").agg(
        F.count("*").alias("times"), F.bool_or(F.col("turn").isNull()).alias("at_null"), F.min("turn").alias("first")
    )
    seen = seen.where("times > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "at_null", "first")
    again = F.col("turn").isNotNull() & (F.col("at_null") | (F.col("turn") > F.col("first")))
    units = units.join(seen.hint("rebalance"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    units = units.select("conv_id", "turn", "role", "text", "copies", F.coalesce(again, F.lit(False)).alias("repeated"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one conversation, turn and role meet in a task if their texts begin alike.
    order = units.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 64))
    order = order.sortWithinPartitions("conv_id", "turn", "role", "text")
    found = written(spark, order.mapInArrow(cut(arrow_schema(spark, STRETCHES)), STRETCHES), "stretches")
    names = found.columns
    known = [x.split()[0] for x in LIGHT.split(", ")]
    light = [c if c in known else F.lit(None).cast(found.schema[c].dataType).alias(c) for c in names]
    heavy = ["conv_id", "heavy", "part", "place", "audits", "roles", "texts", "copies"]
    heavy = [
        F.lit(1).alias(c) if c == "heavy" else c if c in heavy else F.lit(None).cast(found.schema[c].dataType).alias(c)
        for c in names
    ]
    met = found.select(*light).unionByName(found.select(*heavy))
    if ids is not None:
        one = ids.select(F.col("conv_id").cast("long")).distinct()
        met = met.unionByName(one.withColumn("heavy", F.lit(-1)), allowMissingColumns=True)
    met = met.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "heavy", "part", "place")
    return met.mapInArrow(mend(arrow_schema(spark, RESULT)), RESULT)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults to be found, by the CRC-32 of conv_id:turn modulo 20; nulls are a space.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question
    marks, 3 repeats it, 4 makes it the user's.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind")
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.withColumn("copy", F.explode(copies)).drop("copy", "kind")
