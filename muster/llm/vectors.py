"""Near duplicates among vectors by an inverted multi-index.

Unit vectors are cut into two halves, each with a codebook of its own; the pairs of codes
form a grid of cells, and every vector lies in the cell of its two nearest codes. Each
vector then visits cells in the order of how near they can be: two unit vectors of cosine c
lie sqrt(2 - 2c) apart, the parts of that distance in the two halves add up as squares, and
a half can lie in another code's region only beyond the plane midway between the codes. The
multi-sequence traversal walks the two lists of such distances from the smallest sum on and
stops when no cell left can hold a vector near enough. Its target recall is all pairs: no
link is lost, whatever the codebooks are, which only decide how many cells are visited.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.common import components, written
from muster.llm.neighbours import usable

COSINE = 0.98
#: Rows that the codebooks are fitted on at most, drawn by a hash; rounds of the fit.
SAMPLE, ROUNDS = 8192, 12
#: Distinct vectors of a cell that the number of codes aims at, and codes of a half.
CELL, LEAST_CODES, MOST_CODES = 512, 4, 256
#: Vectors of a cell compared at once, and visitors that they are compared with.
BLOCK, VISITORS = 2048, 8192


def unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, float) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k means of the rows, from rows evenly apart; a code that loses all rows stays put."""
    codes = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ codes.T - (codes**2).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, near, x)
        codes[n > 0] = total[n > 0] / n[n > 0][:, None]
    return np.unique(codes, axis=0)


def beyond(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code of each row, and for each code the squared distance to its side."""
    square = ((x[:, None] - codes) ** 2).sum(2)
    near = square.argmin(1)
    apart = np.sqrt(((codes[:, None] - codes) ** 2).sum(2))[near]
    apart[np.arange(len(x)), near] = 1.0
    gap = (square - square[np.arange(len(x)), near][:, None]) / (2 * apart)
    return near, np.maximum(gap, 0) ** 2


def traverse(a: np.ndarray, b: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells (i, j) with a[i] + b[j] <= limit, smallest sums first."""
    left, right = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out = [(a[left[0]] + b[right[0]], 0, 0)], {(0, 0)}, []
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            break
        out.append((int(left[i]), int(right[j])))
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(left) and n[1] < len(right) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (a[left[n[0]]] + b[right[n[1]]], *n))
    return out


def compare(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cosine: float, within: bool) -> tuple:
    """Links of x among themselves (if within) and with y: counts by weight, and a root each.

    weight: copies of each row of x and then of y. Returns for x and y, one after the
    other, the copies linked to each and the position of the first row that it is joined to.
    """
    n, rows = len(x), np.concatenate([x, y])
    count, root = np.zeros(len(rows), np.int64), np.arange(len(rows))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0 if within else n, len(rows), 1024):
        part = rows[at : at + 1024]
        near = part @ x.T >= cosine
        if at < n:
            # Rows of x: each pair is met from both sides, a row's own entry is none.
            near[np.arange(len(part))[at + np.arange(len(part)) < n], np.arange(at, min(at + len(part), n))] = False
        count[at : at + 1024] += near @ weight[:n]
        later = at + np.arange(len(part)) >= n
        count[:n] += near[later].T @ weight[at : at + 1024][later]
        for i in near.any(1).nonzero()[0]:
            # One link to each group already joined is enough for the components.
            for r in np.unique(root[near[i].nonzero()[0]]):
                a, b = sorted((find(int(r)), find(at + int(i))))
                root[b] = a
    return count, np.array([find(i) for i in range(len(rows))])


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors(vec_id, embedding, label).

    Rows of one label, not null, are linked if their cosine in double precision is at least
    `cosine`. n_links counts the other rows linked directly, copies included; component_id is
    the smallest vec_id reachable by links, the row's own included; kept says whether that
    is its own. Vectors that are null, all zero, or hold a null or non-finite component link
    with nothing, nor do vectors of different numbers of components. Rows without a vec_id
    take part, but name no component; if nothing else does, component_id is null and kept
    is false. No rows give no rows. Extra columns are not looked at.

    Equal vectors of a label are one class with a count. Classes go to their cell once and
    visit others; of two cells the one with the smaller number is visited by the other's
    rows. Large cells are cut into blocks, and a block's visitors into slices, so no task
    holds more than BLOCK + VISITORS rows of a group; only counts and one link for each row
    leave it.
    """
    rows = vectors.select(
        "vec_id",
        F.when(usable(F.col("embedding")), F.col("label")).alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    ).withColumns({"one": F.xxhash64("v"), "two": F.hash("v")})
    names = ["label", "one", "two"]
    classes = (
        rows.where("label is not null")
        .groupBy(*names)
        .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("v").alias("v"))
        .withColumn("d", F.size("v"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = written(spark, classes, "classes")  # from here on `node` is fixed
    sizes = {r.d: r.n for r in classes.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(1).collect()}
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d, n in sizes.items():
        sample = classes.where(F.col("d") == d).orderBy(F.xxhash64("node")).limit(SAMPLE).select("v").toPandas()
        x = unit(sample["v"].tolist())
        k = int(np.clip(np.sqrt(n / CELL), LEAST_CODES, MOST_CODES))
        books[d] = codebook(x[:, : d // 2], k), codebook(x[:, d // 2 :], k)
    # Slightly more than the distance at the threshold, for rounding.
    limit = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for d, g in f.groupby("d"):
                if d not in books:
                    yield g[["node", "label", "d", "n", "v"]].assign(cell=0, visits=[[] for _ in range(len(g))])
                    continue
                x = unit(g["v"].tolist())
                (left, a), (right, b) = beyond(x[:, : d // 2], books[d][0]), beyond(x[:, d // 2 :], books[d][1])
                width = len(books[d][1])
                cell = left * width + right
                visits = [
                    [i * width + j for i, j in traverse(a[r], b[r], limit) if i * width + j < cell[r]] for r in range(len(g))
                ]
                yield g[["node", "label", "d", "n", "v"]].assign(cell=cell, visits=visits)

    schema = "node long, label long, d int, n long, v array<double>, cell int, visits array<int>"
    placed = classes.select("node", F.col("label").cast("long"), "d", "n", "v").mapInPandas(assign, schema)
    placed = written(spark, placed, "cells")
    where = ["label", "d", "cell"]
    held = placed.groupBy(*where).agg(F.count("*").alias("held"))
    calls = placed.select("label", "d", F.explode("visits").alias("cell")).groupBy(*where).agg(F.count("*").alias("calls"))
    cells = held.join(calls, where, "left").select(
        *where,
        F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.coalesce("calls", F.lit(0)) + F.col("held")) / VISITORS).cast("int").alias("slices"),
    )
    cells = written(spark, cells, "grid")
    one = F.xxhash64("node")
    body = ["node", "n", "v"]
    home = placed.join(cells, where).withColumn("block", F.pmod(one, F.col("blocks")).cast("int"))
    slice_ = F.pmod(F.hash("node"), F.col("slices")).cast("int").alias("slice")
    base = home.select(
        *where, "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("base"), *body
    )
    # Blocks of one cell visit each other, too: the later the earlier.
    around = home.where("block > 0").select(
        *where, F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block"), slice_, F.lit(False).alias("base"), *body
    )
    called = placed.select("label", "d", F.explode("visits").alias("cell"), *body).join(cells, where)
    called = called.select(
        *where, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), slice_, F.lit(False).alias("base"), *body
    )

    def meet(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["base", "node"], ascending=[False, True], ignore_index=True)
        x = unit(f["v"].tolist())
        n, node = int(f["base"].sum()), f["node"].to_numpy()
        count, root = compare(x[:n], x[n:], f["n"].to_numpy(), cosine, key[-1] == 0)
        out = pd.DataFrame({"node": node, "links": count, "root": node[root]})
        return out[count > 0]

    groups = base.unionByName(around).unionByName(called).groupBy(*where, "block", "slice")
    met = written(spark, groups.applyInPandas(meet, "node long, links long, root long"), "met")
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(spark, met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = classes.join(counts, "node", "left").join(roots, "node", "left").select(
        *names, "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")
    )
    joined = written(spark, joined, "joined")
    ids = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = written(spark, joined.join(ids, "root").select(*names, "n_links", "component_id"), "found")
    fine = rows.where("label is not null").select("vec_id", *names).join(found, names)
    alone = rows.where("label is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = fine.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
