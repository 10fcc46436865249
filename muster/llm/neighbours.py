"""Approximate nearest neighbours by cross-polytope hashing.

Each table rotates unit vectors by three rounds of random signs and a fast Hadamard
transform; a vector's bucket is the signed axis it then lies nearest to. A query probes, in
each table, the buckets of the axes it lies nearest to itself, and all candidates met there
are reranked by the exact inner product.

Largest inner products are nearest angles only among vectors of like length. Vectors are
therefore hashed within bands of length (a factor of 2 to the power 1/4), and a query probes
every band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.llm.common import written

#: Tables, and the fewest buckets of each that a query probes. How many it takes depends on
#: dimension, lengths and directions, and is measured: SAMPLE queries of each dimension are
#: compared with every row, and probes are as many as find the share RECALL of their nearest.
TABLES, PROBES = 8, 16
SAMPLE, RECALL = 64, 0.95
#: Rows of a bucket that are compared at once, and queries that they are compared with; larger
#: buckets are cut into blocks, and more queries into parts that meet each block.
BLOCK, ASKED = 4096, 8192
SEED = 7


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that isn't 0."""
    x = vector.cast("array<double>")
    inf = float("inf")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0), F.lit(False))


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-random rotation of rows, padded with zeros to a power of two."""
    n, d = x.shape
    m = 1 << max(0, (d - 1).bit_length())
    y = np.zeros((n, m))
    y[:, :d] = x
    signs = np.random.default_rng((SEED, table, m)).choice([-1.0, 1.0], (3, m))
    for s in signs:
        y = y * s
        h = 1
        while h < m:
            y = y.reshape(n, m // (2 * h), 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, m)
            h *= 2
    return y / m**1.5


def probes(x: np.ndarray, table: int, n: int) -> np.ndarray:
    """The n signed axes that each row lies nearest to, nearest first: 2 * axis + (1 if negative)."""
    y = rotate(x, table)
    near = np.stack([y, -y], 2).reshape(len(y), -1)
    return np.argsort(-near, axis=1, kind="stable")[:, :n]


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and the band of their lengths; a largest component may be near overflow."""
    x = np.array([np.asarray(r, float) for r in rows])
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    length = np.linalg.norm(x, axis=1, keepdims=True)
    band = np.floor(4 * (np.log2(length) + np.log2(top)) + 0.5).astype(np.int64)[:, 0]
    return x / length, band


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def best(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple]:
    """For each query the ids and products of its k best rows, ties to the smaller id.

    own: the id that a query may not find. Matrix products choose, with a margin for their
    rounding; inner() decides.
    """
    out = []
    margin = 1e-12 * np.abs(rows).max() * rows.shape[1]
    for at in range(0, len(query), 512):
        q = query[at : at + 512]
        near = q @ rows.T
        mine = own[at : at + 512]
        near[ids[None] == mine[:, None]] = -np.inf
        least = near.min(1) if near.shape[1] <= k else np.partition(near, -k, axis=1)[:, -k]
        least = np.nan_to_num(least, neginf=-np.inf) - margin * np.maximum(np.abs(q).max(1), 1e-300)
        for i in range(len(q)):
            c = ((near[i] >= least[i]) & (near[i] > -np.inf)).nonzero()[0]
            score = inner(np.broadcast_to(q[i], (len(c), q.shape[1])), rows[c])
            order = np.lexsort((ids[c], -score))[:k]
            out.append((ids[c][order], score[order]))
    return out


def axes(d: int) -> int:
    """Signed axes of a table: its buckets in a band."""
    return 2 << max(0, (d - 1).bit_length())


def choose_probes(named: DataFrame, k: int, every: int, tables: int, least: int) -> dict[int, int]:
    """Probes in each table by dimension; 0 where all rows are to be scanned.

    They are scanned where rows are few, and where so many probes would meet as many rows.
    """
    plan = {}
    d = F.size("v")
    for r in named.groupBy(d.alias("d")).agg(F.count("*").alias("n")).collect():
        plan[r.d] = 0
        if r.n <= BLOCK or tables * least >= axes(r.d):
            continue
        mine = named.where(d == r.d)
        asked = mine.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "v").limit(SAMPLE).collect()
        if not asked:
            continue
        q, own = np.array([x.v for x in asked]), np.array([x.vec_id for x in asked])

        def rank(frames: Iterator[pd.DataFrame], q=q, own=own, n=axes(r.d)) -> Iterator[pd.DataFrame]:
            unit = _unit(list(q))[0]
            place = [np.argsort(probes(unit, t, n), axis=1) for t in range(tables)]
            for f in frames:
                if f.empty:
                    continue
                x, ids = np.stack(f["v"].tolist()), f["vec_id"].to_numpy()
                bucket = np.stack([probes(_unit(list(x))[0], t, 1)[:, 0] for t in range(tables)])
                row = {i: j for j, i in enumerate(ids)}
                out = []
                for i, (found, score) in enumerate(best(q, x, ids, own, k)):
                    for v, s in zip(found, score, strict=True):
                        out.append((i, s, min(int(place[t][i, bucket[t, row[v]]]) for t in range(tables))))
                yield pd.DataFrame(out, columns=["q", "score", "probe"])

        nearest = Window.partitionBy("q").orderBy(F.desc("score"))
        met = mine.mapInPandas(rank, "q long, score double, probe int").withColumn("rank", F.row_number().over(nearest))
        at = sorted(x.probe for x in met.where(F.col("rank") <= k).select("probe").collect())
        need = max(least, at[int(np.ceil(RECALL * len(at))) - 1] + 1) if at else axes(r.d)
        plan[r.d] = need if tables * need < axes(r.d) else 0
    return plan


def search(
    spark: SparkSession,
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    tables: int = TABLES,
    n_probes: int = PROBES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query.

    vectors(vec_id, embedding): queries are the rows whose vec_id is divisible by `every`,
    candidates all rows but those of the query's own vec_id. score is the inner product in
    double precision on the vectors as they are; ties go to the smaller vec_id. Vectors that
    are null, all zero, or hold a null or non-finite component take no part, nor do rows
    without a vec_id. Vectors meet only those of their own number of components. Of rows
    that repeat a vec_id, each is searched with, and the best counts. No rows give no rows.
    Extra columns are not looked at.

    Every row is indexed. Where choose_probes() says so, in one table, of which queries probe
    all buckets, so that the result is exact; else in each table, and queries that met fewer
    than k rows probe all buckets of the first. Vectors travel to their buckets once a table,
    and queries once a probe; only the k best of each meeting leave it. A bucket of any size is
    cut into blocks of some BLOCK rows, by a hash of the row, and its queries, in parts of some
    ASKED, go to each; the table of bucket sizes has 2 * dimensions * tables rows for each band
    of lengths.
    """
    named = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    named = named.where("vec_id is not null").where(usable(F.col("v")))
    bucket = "d int, t int, band long, axis int"
    plan = choose_probes(named, k, every, tables, n_probes)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for d, g in f.groupby(f["v"].map(len)):
                x, band = _unit(g["v"].tolist())
                for t in range(tables if plan[d] else 1):
                    yield pd.DataFrame(
                        {"d": d, "t": t, "band": band, "axis": probes(x, t, 1)[:, 0], "vec_id": g["vec_id"], "v": g["v"]}
                    )

    def probe(frames: Iterator[pd.DataFrame], whole: bool = False) -> Iterator[pd.DataFrame]:
        for f in frames:
            for d, g in f.groupby(f["v"].map(len)):
                x, _ = _unit(g["v"].tolist())
                n = 0 if whole else plan[d]
                for t in range(tables if n else 1):
                    near = probes(x, t, n or axes(d))
                    n = near.shape[1]
                    yield pd.DataFrame(
                        {
                            "d": d,
                            "t": t,
                            "axis": near.ravel(),
                            "vec_id": g["vec_id"].repeat(n),
                            "v": g["v"].repeat(n),
                        }
                    )

    key = ["d", "t", "band", "axis"]
    indexed = named.mapInPandas(index, f"{bucket}, vec_id long, v array<double>")
    sizes = indexed.groupBy(*key).agg(F.count("*").alias("n"))
    sizes = written(spark, sizes.select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    # One row for each bucket: at most 2 * dimensions * tables for each band, which no
    # number of vectors changes.
    few = F.broadcast(sizes)
    rows = indexed.join(few, key).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int"))
    queries = named.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-queries.count() // ASKED))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found, own = [], np.empty(0, np.int64)
        if len(asked) and len(rows):
            q, x = np.stack(asked["v"].tolist()), np.stack(rows["v"].tolist())
            own = asked["vec_id"].to_numpy()
            found = best(q, x, rows["vec_id"].to_numpy(), own, k)
        ids, scores = (pd.Series([f[i] for f in found], dtype=object) for i in (0, 1))
        return pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores})

    columns = [*key, "block", "part"]

    def pairs(queries: DataFrame, whole: bool) -> DataFrame:
        asked = queries.mapInPandas(lambda f: probe(f, whole), "d int, t int, axis int, vec_id long, v array<double>")
        asked = asked.join(few, ["d", "t", "axis"])
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asked = asked.withColumn("part", F.pmod(F.hash("vec_id", "v"), F.lit(parts)))
        met = (
            asked.select(*columns, "vec_id", "v")
            .groupBy(*columns)
            .cogroup(rows.select(*columns, "vec_id", "v").groupBy(*columns))
            .applyInPandas(meet, "query_id long, vec_id array<long>, score array<double>")
        )
        out = met.select("query_id", F.explode(F.arrays_zip("vec_id", "score")).alias("x"))
        return out.select("query_id", F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))

    found = pairs(queries, False)
    if any(plan.values()):
        found = written(spark, found, "found")
        enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k)
        short = queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti")
        found = found.unionByName(pairs(short, True))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
