"""Hard negatives by exact integer scores, multiplied in a residue number system.

Components become integers, and a score is their inner product. It is never computed in
one piece: for several small primes, the residues of anchors and rows are multiplied as
float32 matrices, whose sums stay below 2**24 and are therefore exact. The Chinese remainder
theorem, as balanced mixed-radix digits, gives the signed score back; there are as many
primes as the largest possible score asks for. Two passes over the same blocks: the best
rows of the anchor's label, then, for each of these, the best rows of other labels whose
scores lie in a window below its score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.llm.common import written

#: Components are multiplied by this before they are cut to whole numbers.
SCALE = 256
#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between LOW hundredths of the positive's and all of it.
LOW = 80
#: Primes are below this, so that WIDE products of two balanced residues add up below 2**24.
LARGEST, WIDE = 256, 1024
#: Scores stay below this, also times five.
MOST = 1 << 60
#: Anchors that a task holds, and the tile of scores that it computes at once.
ANCHORS = 4096
TILE_ANCHORS, TILE_ROWS = 128, 4096
NONE = np.iinfo(np.int64).min


def primes(most: float) -> list[int]:
    """The largest odd primes below LARGEST whose product exceeds twice the largest score."""
    out, product = [], 1
    for p in range(LARGEST - 1, 2, -2):
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
            if product > 2 * most + 1:
                break
    return out


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo an odd p between -(p // 2) and p // 2."""
    h = p // 2
    return (x + h) % p - h


def residues(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    return [balanced(x, p).astype(np.float32) for p in moduli]


def products(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact inner products of rows given by residues.

    Digit i of a score is what the digits before it leave, divided by their primes, modulo
    prime i. Balanced digits carry the sign, so whole numbers may wrap on the way.
    """
    digits: list[np.ndarray] = []
    score = np.zeros((len(a[0]), len(b[0])), np.int64)
    weight = 1
    for i, p in enumerate(moduli):
        rest = np.zeros(score.shape, np.float32)
        for at in range(0, a[i].shape[1], WIDE):
            # Residues of a block are below 128: the sum with its remainder stays exact.
            part = a[i][:, at : at + WIDE] @ b[i][:, at : at + WIDE].T
            rest += part - p * np.rint(part / p)
        rest = balanced(rest.astype(np.int32), p)
        for q, digit in zip(moduli, digits, strict=False):
            rest = balanced((rest - digit) * pow(q, -1, p), p)
        digits.append(rest)
        # Wraps in 64 bits like the sum; the sum itself fits.
        score += rest * np.int64((weight + (1 << 63)) % (1 << 64) - (1 << 63))
        weight *= p
    return score


class Best:
    """The k best rows of each of n slots so far: highest score, then smallest id.

    Rows must come in the order of their ids: a later row never wins a tie.
    """

    def __init__(self, n: int, k: int):
        self.k, self.count = k, np.zeros(n, np.int64)
        self.score, self.id = np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of the slots from `at` on, with NONE for a row that a slot may not take."""
        k, end = self.k, at + len(scores)
        least = self.score[at:end, -1:]
        for i in (scores.max(1) > least[:, 0]).nonzero()[0]:
            mine = scores[i]
            if len(mine) > k:
                kth = np.partition(mine, -k)[-k]
                # All above the k-th and, of those equal to it, the first.
                above = (mine > max(kth, least[i, 0])).nonzero()[0]
                equal = (mine == kth).nonzero()[0][: k - len(above)] if kth > least[i, 0] else above[:0]
                take = np.concatenate([above, equal])
            else:
                take = (mine > least[i, 0]).nonzero()[0]
            score = np.concatenate([self.score[at + i], mine[take]])
            found = np.concatenate([self.id[at + i], ids[take]])
            order = np.lexsort((found, -score, score == NONE))[:k]
            self.score[at + i], self.id[at + i] = score[order], found[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot, id and score of everything held."""
        slot, place = (self.score > NONE).nonzero()
        return slot, self.id[slot, place], self.score[slot, place]


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d).astype(np.int64)


def runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The parts of a batch with equal values of the named columns, side by side."""
    keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], 1)
    cuts = [0, *((keys[1:] != keys[:-1]).any(1).nonzero()[0] + 1).tolist(), len(keys)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            yield tuple(keys[a].tolist()), batch.slice(a, b - a)


KEY = ["anchors", "strip", "d"]
OUT = "node long, anchor_id long, slot int, vec_id long, score long"


def matcher(moduli: list[int], positive: bool, k: int) -> Callable:
    """A function for mapInArrow over rows in the order of KEY, is_row and vec_id.

    First come the anchors of a block, then the rows of a strip, of which there may be any
    number: a task holds the anchors, one tile of scores and the best of each slot.
    """

    def finish(state: dict | None) -> Iterator[pa.RecordBatch]:
        if state and "best" in state:
            for slot, best in enumerate(state["best"]):
                i, found, score = best.rows()
                frame = pd.DataFrame({"node": state["node"][i], "anchor_id": state["id"][i]})
                frame = frame.assign(slot=np.int32(slot), vec_id=found, score=score)
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    def ready(state: dict, d: int) -> None:
        parts = state["parts"]
        state["node"] = np.concatenate([p.column("node").to_numpy() for p in parts])
        state["id"] = np.concatenate([p.column("vec_id").to_numpy() for p in parts])
        state["label"] = np.concatenate([p.column("label").to_numpy() for p in parts])
        state["residues"] = residues(np.concatenate([matrix(p.column("q"), d) for p in parts]), moduli)
        # A slot of an anchor is a window of scores, from low to high.
        n = len(state["id"])
        if positive:
            state["low"], state["high"] = np.full((n, 1), NONE), np.full((n, 1), MOST)
        else:
            lists = [x for p in parts for x in p.column("scores").to_pylist()]
            state["high"] = np.full((n, max(map(len, lists))), NONE)
            for i, x in enumerate(lists):
                state["high"][i, : len(x)] = x
            # The least score with LOW * high <= 100 * score, in whole numbers.
            g = math.gcd(LOW, 100)
            state["low"] = -((-(LOW // g) * state["high"]) // (100 // g))
        state["best"] = [Best(n, k) for _ in range(state["high"].shape[1])]

    def take(state: dict, rows: pa.RecordBatch, d: int) -> None:
        for at in range(0, len(rows), TILE_ROWS):
            part = rows.slice(at, TILE_ROWS)
            ids, node, label = (part.column(c).to_numpy() for c in ("vec_id", "node", "label"))
            of_rows = residues(matrix(part.column("q"), d), moduli)
            for a in range(0, len(state["id"]), TILE_ANCHORS):
                b = a + TILE_ANCHORS
                score = products([x[a:b] for x in state["residues"]], of_rows, moduli)
                same = state["label"][a:b, None] == label[None]
                fit = same & (state["node"][a:b, None] != node[None]) if positive else ~same
                for slot, best in enumerate(state["best"]):
                    low, high = state["low"][a:b, slot, None], state["high"][a:b, slot, None]
                    best.add(a, np.where(fit & (score >= low) & (score <= high), score, NONE), ids)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for (*key, is_row), part in runs(batch, [*KEY, "is_row"]):
                if key != now:
                    yield from finish(state)
                    now, state = key, {"parts": []}
                if not is_row:
                    state["parts"].append(part)
                elif state["parts"]:
                    if "best" not in state:
                        ready(state, key[2])
                    take(state, part, key[2])
        yield from finish(state)

    return match


def mine(spark: SparkSession, vectors: DataFrame, every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors(vec_id, embedding, label): each component x becomes floor(SCALE * x), and a
    row's score is its inner product with the anchor's; higher scores come first, ties by
    smaller vec_id. Anchors are the rows whose vec_id is divisible by `every`, their
    positives the first POSITIVES other rows of the same label. For each of them come the
    first NEGATIVES rows of other labels with LOW * positive_score <= 100 * negative_score
    and negative_score <= positive_score; a positive without any is not in the result.

    Rows without a vec_id or label take no part, nor do null vectors and those with a null or
    non-finite component. Vectors meet only those of as many components; those of none all
    score 0. Rows that repeat a vec_id are rows of their own: "other" is another row. Scores
    that could pass MOST raise a ValueError. No rows give no rows; extra columns are not
    looked at.

    Anchors against all rows, in blocks: rows are dealt to strips, as many as grow with the
    square root of the table, anchors to blocks of some ANCHORS. Each row goes once to each
    block of anchors, each anchor once to each strip, and only the best of an anchor and
    strip leave a task, which reads its strip as a stream. Strips are dealt by row, so equal
    vectors, ids or labels don't meet in one.
    """
    inf = float("inf")
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    rows = vectors.where("vec_id is not null and label is not null").where(F.coalesce(fine, F.lit(False)))
    integers = F.transform(v, lambda x: F.floor(SCALE * x).try_cast("int"))
    # No less than the square of the integers' length, which bounds every score.
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(SCALE * F.abs(x) + 1, 2))
    rows = rows.select(
        F.monotonically_increasing_id().alias("node"), F.col("vec_id").cast("long"), F.col("label").cast("long"),
        integers.alias("q"), F.size("embedding").alias("d"), square.alias("square"),
    )
    rows = written(spark, rows, "integers")  # from here on `node` is fixed
    most = rows.agg(F.max("square")).first()[0] or 0.0
    if not most < MOST:
        raise ValueError(f"scores may reach {most:.3g}, more than {MOST}")
    moduli = primes(most)
    n, held = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    strips, blocks = max(1, int(n**0.5 / 8)), max(1, -(-held // ANCHORS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda n, *salt: F.pmod(F.xxhash64("node", *map(F.lit, salt)), F.lit(n)).cast("int")
    columns = [*KEY, "is_row", "node", "vec_id", "label", "q", "scores"]
    # Only of lengths that some anchor has.
    lengths = rows.where(F.col("vec_id") % every == 0).select("d").distinct()
    others = rows.join(lengths, "d", "left_semi").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("anchors"), deal(strips).alias("strip"), "d",
        F.lit(1).alias("is_row"), "node", "vec_id", "label", "q", F.lit(None).cast("array<long>").alias("scores"),
    )

    def matched(anchors: DataFrame, positive: bool, k: int) -> DataFrame:
        asked = anchors.select(
            deal(blocks, 1).alias("anchors"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), "d",
            F.lit(0).alias("is_row"), "node", "vec_id", "label", "q", "scores",
        )
        met = asked.unionByName(others).select(*columns)
        met = met.repartition(parts, "anchors", "strip").sortWithinPartitions(*KEY, "is_row", "vec_id")
        found = met.mapInArrow(matcher(moduli, positive, k), OUT)
        order = Window.partitionBy("node", "slot").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("scores", F.lit(None).cast("array<long>"))
    positives = matched(anchors, True, POSITIVES).groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives")
    )
    positives = written(spark, positives, "positives")
    asked = anchors.drop("scores").join(positives, "node").withColumn("scores", F.col("positives.score"))
    found = matched(asked, False, NEGATIVES)
    positive = F.col("positives")[F.col("slot")]
    return found.join(positives, "node").select(
        "anchor_id",
        positive["vec_id"].alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        positive["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
