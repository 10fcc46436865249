"""SimHash, multi-index, components: against all pairs."""

import numpy as np
import pytest
import xxhash

from muster.llm import simhash, vectors
from muster.llm.common import components


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    code = simhash.golay()
    words = rng.integers(0, 1 << 23, 300)
    flips = np.array([1 << a | 1 << b for a in range(23) for b in range(a, 23)])
    for w in words[:20]:
        row, index = code.indices(np.append(w, w ^ flips))
        own = set(index[row == 0])
        assert len(own) in (1, 6)
        met = {r for r, i in zip(row, index, strict=True) if i in own}
        assert met == set(range(len(flips) + 1))
    distance = np.bitwise_count(words ^ words ^ code.error[code.remainder(words)])
    assert distance.max() <= 3


def test_simhash_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(25):
        base = list(rng.choice(vocabulary, 120))
        texts.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            copy[rng.integers(120)] = "changed"
            texts.append("\t".join(copy))
    texts += ["", "  \n", "ONE two", "one TWO", texts[0], "x" * 5000]
    schema = "doc_id long, text string, component_id string"
    docs = [(i, t, "clash") for i, t in enumerate(texts)]
    rows = simhash.near_duplicates(spark, spark.createDataFrame(docs, schema)).collect()
    prints = [plain_fingerprint(t) for t in texts]
    linked = [
        (a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2
    ]
    assert len(linked) > 40
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in rows}
    assert got == {i: (p, c) for i, (p, c) in enumerate(zip(prints, groups(len(texts), linked), strict=True))}


def test_simhash_odd_rows(spark):
    docs = [(5, None), (3, ""), (None, ""), (7, "a b c d"), (7, "a b c d"), (9, "a b c d")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = simhash.near_duplicates(spark, docs).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 3), (3, 3), (5, 3), (7, 7), (7, 7), (9, 7)]
    kept = simhash.first_of_each(spark, docs)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [3, 7]
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_each_text_keeps_a_near_duplicate(spark):
    """Repeated and null ids: one row of each group stays, whatever its texts' other ids are."""
    x, y, z = ("one two three four", "five six seven eight nine", "ten eleven twelve")
    docs = [(5, x), (7, x), (5, y), (3, y), (None, z), (None, z), (None, x), (9, None), (None, ""), (4, "a b"), (4, "a b")]
    frame = spark.createDataFrame([(*d, "n", 1) for d in docs], "doc_id long, text string, n string, kept int")
    kept = simhash.first_of_each(spark, frame)
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(3, y), (4, "a b"), (5, x), (9, None), (None, z)]
    assert simhash.first_of_each(spark, frame.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)]
    want = groups(6000, pairs)
    got = components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: want[x] for a, b in pairs if a != b for x in (a, b)}
    assert len(got) == len({r.node for r in got})


@pytest.mark.parametrize("block", [vectors.BLOCK, 8])
def test_multi_index_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "VISITORS", 4 * block)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 8))
    x = np.concatenate([b + rng.normal(size=(12, 8)) * 0.08 * np.linalg.norm(b) / 3 for b in base])
    x[5] = x[3]
    rows = [(i, v.tolist(), i % 3 if i else None, 1.5) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1, 0.0), (n + 1, [0.0] * 8, 1, 0.0), (n + 2, [float("nan")] + [1.0] * 7, 1, 0.0), (n + 3, [1.0, None], 1, 0.0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links double")
    got = {r.vec_id: r for r in vectors.near_duplicates(spark, frame).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = [(a, b) for a in range(1, n) for b in range(1, a) if a % 3 == b % 3 and u[a] @ u[b] >= 0.98]
    assert len(near) > 100 and len(got) == len(rows)
    want = groups(len(rows), near)
    assert [got[i].component_id for i in range(len(rows))] == want
    assert [got[i].n_links for i in range(n)] == [sum(i in p for p in near) for i in range(n)]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert vectors.near_duplicates(spark, frame.limit(0)).count() == 0
