"""Conversation repair against every audit there is, for short conversations."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from muster.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, copies string, piece int"
PATTERN = re.compile(r"(s?(ua)+)?\Z")


def everything(rows, most, done=(), cost=0, audit=""):
    """All (cost, audit, repaired rows) of rows (role, text, must go, truncated) that cost no more
    than `most`; at most two insertions in one place, since three are one and a pair that may go."""
    inserted = [((), 0, "")]
    for role in ("user", "assistant"):
        inserted.append((((role, ""),), 5, "I"))
        inserted += [(((role, ""), (other, "")), 10, "II") for other in ("user", "assistant")]
    for new, more, edits in inserted:
        now, total, said = done + new, cost + more, audit + edits
        if total > most:
            continue
        if not rows:
            yield total, said, now
            continue
        (role, text, gone, truncated), rest = rows[0], rows[1:]
        yield from everything(rest, most, now, total + 2, said + "D")
        if not gone:
            extra = 5 * truncated
            if role:
                yield from everything(rest, most, (*now, (role, text)), total + extra, said + "K")
            for other in ("user", "assistant"):
                yield from everything(rest, most, (*now, (other, text)), total + extra + 1, said + "R")


def plain(rows):
    """The result's columns for a conversation's rows (turn, role, text), from all audits."""
    fixed = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    fixed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged, counts = set(), [], [0, 0, 0]
    for _, role, text in fixed:
        tail = text.rstrip(" \t\n\v\f\r")
        faults = [not tail, (role, text) in seen, bool(tail) and tail[-1] not in ".!?"]
        seen.add((role, text))
        if any(faults):
            counts[faults.index(True)] += 1
        judged.append((role, text, faults[0] or faults[1], faults[2]))
    turns = {t for t, _, _ in fixed if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[:1] for _, r, _ in fixed]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    # Deleting all rows is always possible.
    legal = (x for x in everything(judged, 2 * len(judged)) if PATTERN.match("".join(r[:1] for r, _ in x[2])))
    cost, audit, done = min(legal)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
    return (gaps, *counts, illegal, cost, audit, digest)


def mended(spark, rows, ids=None):
    frame = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    pieces = conversations.repair(spark, frame, ids).collect()
    out = {}
    for r in sorted(pieces, key=lambda r: r.piece):
        out.setdefault(r.conv_id, []).append(r)
    for parts in out.values():
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert [p.last for p in parts] == [False] * (len(parts) - 1) + [True]
        lines = "\n".join(f"{x.role}:{x.text}" for p in parts for x in p.rows)
        assert parts[-1].repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {k: tuple(v[-1][n] for n in names) for k, v in out.items()}


def random_rows(rng, n, most):
    texts = ["a.", "b", "c!", "", " \t", "d?", "e. "]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    out = []
    for c in range(n):
        for t in range(int(rng.integers(1, most))):
            turn = None if rng.random() < 0.1 else int(t + rng.integers(0, 2))
            text = None if rng.random() < 0.05 else texts[rng.integers(len(texts))]
            out.append((c, turn, roles[rng.integers(len(roles))], text))
    return out


@pytest.mark.parametrize("size", [conversations.STRETCH, 1, 2])
def test_against_every_audit(spark, monkeypatch, size):
    monkeypatch.setattr(conversations, "STRETCH", size)
    rows = random_rows(np.random.default_rng(size), 150, 5)
    by_id = {}
    for c, *row in rows:
        by_id.setdefault(c, []).append(row)
    assert mended(spark, rows) == {c: plain(r) for c, r in by_id.items()}


def test_long_conversations_in_stretches(spark, monkeypatch):
    """A conversation over many tasks and stretches costs what one stretch of it does."""
    rng = np.random.default_rng(7)
    rows = [(None, i, ["user", "assistant", "system"][rng.integers(3)], f"{i}{'.?x'[rng.integers(3)]}") for i in range(3000)]
    whole = mended(spark, rows)
    units = [(r[2][:1], True, r[3][-1] == "x", 1) for r in rows]
    cost, audit = min(w for w in (conversations.ways(units, 0)[s] for s in (0, 3)) if w)
    monkeypatch.setattr(conversations, "STRETCH", 7)
    assert mended(spark, rows) == whole
    # Ending on a user's row and an insertion is never cheaper by more than that.
    assert cost - 5 <= whole[None][5] <= cost
    assert len(whole[None][6].replace("I", "")) == len(rows) and (whole[None][5] < cost or whole[None][6] == audit)


def test_colliding_hashes_are_verified(monkeypatch):
    rng = np.random.default_rng(3)
    units = [("sua"[rng.integers(3)], bool(rng.random() < 0.9), bool(rng.random() < 0.3), int(rng.integers(1, 3))) for _ in range(200)]
    want = [conversations.ways(units, e) for e in range(4)]
    monkeypatch.setattr(conversations, "_PRIME", 3)
    assert [conversations.ways(units, e) for e in range(4)] == want
    audits = conversations.Audits()
    words = [tuple(rng.integers(0, 3, 20).tolist()) for _ in range(40)]
    words += [w[:10] + tuple(rng.integers(0, 3, 10).tolist()) for w in words]
    nodes = []
    for w in words:
        node = 0
        for s in w:
            node = audits.add(node, s)
        nodes.append(node)
    for a, x in zip(nodes, words, strict=True):
        assert audits.symbols(a) == list(x)
        assert all(audits.less(a, b) == (x < y) for b, y in zip(nodes, words, strict=True))


def test_odd_rows(spark):
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    long = "word " * 300_000 + "."
    rows = [(1, None, None, None), (2, 5, "user", long), (2, 9, "assistant", "x"), (2, 9, "assistant", "x")]
    rows += [(3, None, "user", "a."), (3, -1, "user", "a."), (3, -(1 << 63), "assistant", "b."), (3, 1 << 62, "assistant", "c.")]
    ids = spark.createDataFrame([(i,) for i in (1, 2, 7, 7, None)], "conv_id long")
    got = mended(spark, rows, ids)
    assert got.pop(7) == nothing and got.pop(None) == nothing
    assert got.pop(1) == plain([(None, None, None)])
    assert got.pop(2) == plain([r[1:] for r in rows if r[0] == 2])
    # Nulls first; the same text again is a duplicate. Turns too far apart for a long are cut.
    assert got.pop(3)[:4] == ((1 << 63) - 1, 0, 1, 0)
    assert not got
    # A third of all rows in one conversation, all equal.
    many = mended(spark, [(1, 1, "user", "a.")] * 2000 + [(i, 1, "user", "a.") for i in range(2, 40)])
    assert many[1][1:7] == (0, 1999, 0, 1999, 3998 + 2, "D" * 2000)
    assert mended(spark, [], ids.limit(0)) == {}


def test_damage(spark):
    rows = [(c, t, "assistant", "a. b? c!") for c in range(30) for t in range(8)]
    rows += [(None, 1, None, None), (1, None, "user", "x.")]
    frame = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text or " ")}.get(kind, text or " ")
        want += [(c, t, "user" if kind == 4 else role or " ", text)] * ((kind > 0) + (kind == 3))
    assert sorted(map(tuple, conversations.damage(frame).collect()), key=repr) == sorted(want, key=repr)
