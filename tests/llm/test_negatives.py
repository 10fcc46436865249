"""Hard negatives: residues against whole products, and the miner against all pairs."""

import numpy as np
import pytest

from muster.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"


@pytest.mark.parametrize(("d", "top"), [(0, 1), (1, 1 << 29), (64, 300), (64, 1 << 24), (2100, 1 << 20)])
def test_products_are_exact(d, top):
    rng = np.random.default_rng(d)
    a, b = rng.integers(-top, top, (9, d)), rng.integers(-top, top, (14, d))
    a[0], b[0] = top, top
    b[1] = -top
    moduli = negatives.primes(float(d) * top * top)
    assert len(moduli) == len(set(moduli)) and all(p < 256 for p in moduli)
    got = negatives.products(negatives.residues(a, moduli), negatives.residues(b, moduli), moduli)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert got.tolist() == want


def plain(rows, every=100):
    """Rows (vec_id, integers, label); all pairs."""
    out = []
    for i, (a, q, label) in enumerate(rows):
        if a % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(q, p, strict=True)), b, other == label)
            for j, (b, p, other) in enumerate(rows)
            if j != i and len(p) == len(q)
        )
        for s, b, _ in [x for x in scored if x[2]][:5]:
            low = [(-t, c) for t, c, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, b, n + 1, c, -s, t) for n, (t, c) in enumerate(low[:5])]
    return sorted(out)


def mined(spark, rows, every=100):
    return sorted(map(tuple, negatives.mine(spark, spark.createDataFrame(rows, SCHEMA), every).collect()))


def integers(rows):
    return [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label, _ in rows]


@pytest.mark.parametrize("blocks", ["few", "many"])
def test_mine_against_all_pairs(spark, monkeypatch, blocks):
    if blocks == "many":
        monkeypatch.setattr(negatives, "ANCHORS", 4)
        monkeypatch.setattr(negatives, "TILE_ANCHORS", 3)
        monkeypatch.setattr(negatives, "TILE_ROWS", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) * 0.3
    x[50:90] = x[10]  # ties, of several labels
    x[200:210] = 0
    rows = [(i, v.tolist(), int(i % 3), "clash") for i, v in enumerate(x)]
    rows += [(300 + i, rng.normal(size=2).tolist(), i % 2, None) for i in range(30)]
    rows += [rows[12], rows[20], (20, rows[33][1], 2, "")]
    got = mined(spark, rows, 10)
    assert got == plain(integers(rows), 10)
    assert len(got) > 300 and len({r[:2] for r in got}) < len(got)


def test_odd_rows(spark):
    one = [0.5, 0.5]
    rows = [
        (0, one, 1, None), (1, one, 1, None), (2, one, 2, None), (3, one, None, None), (None, one, 2, None),
        (4, None, 2, None), (5, [0.5, None], 2, None), (6, [0.5, float("nan")], 2, None), (7, [float("inf"), 0.5], 2, None),
        (8, [0.4, 0.4], 2, None), (9, [0.3, 0.3], 2, None), (100, [], 1, None), (101, [], 1, None), (102, [], 3, None),
        (200, [1.0] * 3, 1, None), (300, [-1.0, -1.0], 1, None),
    ]
    got = mined(spark, rows)
    # floor(256 * 0.4) is 102: 26112 of 32768 is below 80 hundredths. Scores below 0 have no window.
    assert got == [(0, 1, 1, 2, 32768, 32768), (100, 101, 1, 102, 0, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert negatives.mine(spark, frame.limit(0)).count() == 0
    assert negatives.mine(spark, frame.where("vec_id = 200")).count() == 0
    with pytest.raises(ValueError, match="scores may reach"):
        mined(spark, [(0, [1e300], 1, None)])
    long = [(i, [0.25 + i / 1000] * 5000, i % 2, None) for i in range(12)]
    assert mined(spark, long, 4) == plain(integers(long), 4)
