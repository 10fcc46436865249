"""Near duplicates by SimHash, found through Golay codes.

A fingerprint has 64 bits, cut into three segments of 22, 21 and 21 bits. Two fingerprints
that differ in at most two bits agree in one segment at least, and differ in at most two
bits of the segment after it. The perfect binary Golay code (23, 12) absorbs those: all
words within one bit of a segment are decoded, which gives one or six codeword indices, and
two segments at most two bits apart have an index in common, since some word lies within
one bit of both. A key is therefore (segment number, exact segment, one index of the next
segment): at most 18 keys for a fingerprint, and no pair within the distance is missed.

Fingerprints that share a key are verified without listing the pairs of a group: each is
copied to every word within one bit of it (outside the exact segment), and two of them meet
in such a word exactly if they differ in at most two bits there. A word has at most 43
members, so no group grows with the input, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.common import components, null_id, whole_id, written

# Fixed value: generator polynomial of the (23, 12) code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SHINGLE = 3
SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of a text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(p), SEED) for p in parts], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        octets = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, more: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, fp) of each row, and more columns of type long that are not null."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.drop(columns="text").assign(fp=[fingerprint(t, shingle) for t in f["text"]])

    rows = docs.select(whole_id(F.col("doc_id")).alias("doc_id"), *more, "text")
    schema = ", ".join(f"{c} long" for c in rows.columns if c != "text")
    return rows.mapInPandas(each, f"{schema}, fp long").withColumn("doc_id", null_id(F.col("doc_id")))


class Golay:
    """Tables of the code, made when a task first needs them."""

    def __init__(self) -> None:
        powers = [1 << i for i in range(11)]
        while len(powers) < 23:
            x = powers[-1] << 1
            powers.append(x ^ GENERATOR if x >> 11 else x)
        self.powers = powers
        self.low, self.high = self._remainders(powers[:12]), self._remainders(powers[12:])
        one = np.array([0, *(1 << i for i in range(23))])
        errors = np.unique(one[:, None, None] | one[:, None] | one)
        self.error = np.zeros(2048, np.int64)
        self.error[self.remainder(errors)] = errors

    @staticmethod
    def _remainders(powers: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for x in powers:
            out = np.concatenate([out, out ^ x])
        return out

    def remainder(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 4095] ^ self.high[words >> 12]

    def index(self, words: np.ndarray) -> np.ndarray:
        """Index of the one codeword within three bits of each word."""
        return (words ^ self.error[self.remainder(words)]) >> 11

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and indices: the distinct indices of all words within one bit of each."""
        near = words[:, None] ^ np.array([0, *(1 << i for i in range(23))])
        found = np.sort(self.index(near), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        return new.nonzero()[0], found[new]


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def golay_keys(fps: np.ndarray) -> pd.DataFrame:
    """(fp, part, key): up to 18 keys of each fingerprint."""
    bits, out = fps.astype(np.int64).view(np.uint64), []
    cut = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    for part in range(3):
        row, index = golay().indices(cut[(part + 1) % 3])
        out.append(pd.DataFrame({"fp": fps[row], "part": part, "key": part << 34 | cut[part][row] << 12 | index}))
    return pd.concat(out)


def links(spark: SparkSession, fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most two bits apart; fps: distinct fp."""

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield golay_keys(f["fp"].to_numpy(np.int64))

    keys = fps.select("fp").mapInPandas(keyed, "fp long, part int, key long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").hint("rebalance")
    met = keys.join(shared, "key", "left_semi").select("fp", "part").distinct()
    flips = [
        F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64) if not at <= i < at + n))
        for at, n in SEGMENTS
    ]
    by_part = F.when(F.col("part") == 0, flips[0]).when(F.col("part") == 1, flips[1]).otherwise(flips[2])
    words = met.withColumn("flip", F.explode(by_part)).select("part", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    groups = words.groupBy("part", "word").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    pairs = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return pairs.where("a <> b").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs(doc_id, text).

    Rows belong together if a chain of fingerprints, each at most two bits from the next,
    connects them; component_id is the smallest doc_id among them. Null or wordless texts
    have fingerprint 0 and are linked like any other. Rows without a doc_id take part, but
    give no component_id of their own. Repeated rows are returned as often as they come;
    no rows give no rows; other columns are not looked at. A text of any length is read whole.
    """
    rows = written(spark, fingerprints(docs, shingle), "fingerprints")
    return rows.join(_groups(spark, rows), "fp").select("doc_id", "fp", "component_id")


def _groups(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(fp, component_id, root) of each fingerprint of rows(doc_id, fp); root names its group."""
    classes = written(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(spark, links(spark, classes)).withColumnRenamed("node", "fp")
    placed = classes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return written(spark, placed.join(ids, "root").select("fp", "component_id", "root"), "components")


def first_of_each(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, one for each group of near duplicates, with all columns.

    It is the row of the smallest doc_id, a null one last; of several texts under that id the
    one of the smallest hash; of rows equal in doc_id and text any one. So each text that goes
    has a near duplicate that stays, whatever ids are null or repeated. Null and empty texts
    are near duplicates of each other. No rows give no rows.
    """
    # 128 bits of a text, beside the fingerprint of the same row.
    hashes = [F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two")]
    names = ["doc_id", "one", "two"]
    rows = written(spark, fingerprints(docs, shingle, hashes), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), *names, "fp")).alias("row")
    placed = rows.join(_groups(spark, rows).select("fp", "root"), "fp").groupBy("root").agg(least)
    least = placed.select(*(F.col(f"row.{c}").alias(c) for c in names)).alias("least")
    times = rows.groupBy(*names).agg(F.count("*").alias("n")).alias("times")
    same = [F.col(f"times.{c}").eqNullSafe(F.col(f"least.{c}")) for c in names]
    kept = written(spark, times.join(least, same, "left_semi"), "kept")
    text = F.col("docs.text")
    here = [F.col("docs.doc_id").cast("long"), F.xxhash64(text), F.xxhash64(F.lit(1), text)]

    def chosen(of: DataFrame) -> DataFrame:
        # The hint: one plan at every size, in which a hot key is split like any skewed one.
        same = [x.eqNullSafe(F.col(f"kept.{c}")) for x, c in zip(here, names, strict=True)]
        return docs.alias("docs").join(of.alias("kept").hint("merge"), same, "left_semi")

    out = chosen(kept.where("n = 1"))
    repeated = kept.where("n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(chosen(repeated).dropDuplicates(["doc_id", "text"]))
    return out
