"""Toxicity classifier with counterfactual regularisation.

A sparse logistic model over which words, and which beginnings of words, a text holds. It is
fitted on labelled texts beside their counterfactuals: the same text with each identity term
swapped for another one of its group. The loss adds the squared difference of the two
scores, so that the name of a group is no reason for a score. Weights are never negative,
and an L1 penalty sets those of words that tell nothing to exactly zero: long clean texts
gather nothing, and a long text does not outweigh its toxic words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.words import ragged, slices, split_words

#: Most labelled documents that the classifier is fitted on, drawn by a hash of their id.
SAMPLE = 6_000
#: Words that enter the fit at most: those whose labels differ most from the average.
VOCABULARY = 5_000
#: Documents that a word must occur in; toxic documents beyond the expected ones that it must
#: have for a weight (the L1 penalty); weight of the counterfactual loss; steps of the fit.
LEAST_DOCS, EVIDENCE, COUNTERFACTUAL, STEPS = 3, 2.5, 5.0, 300
#: Terms that are swapped within their group.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives", "refugees"),
    ("frauen", "männer"),
    ("juden", "christen", "muslime"),
    ("mujeres", "hombres"),
    ("judíos", "cristianos", "musulmanes"),
    ("femmes", "hommes"),
    ("juifs", "chrétiens", "musulmans"),
)
PREFIXES = (4, 5)
_CACHE = 150_000
_WORD = re.compile(r"[^\W_]+")


def swaps(groups=IDENTITY) -> dict[str, str]:
    """The term that each identity term is swapped for: the next one of its group."""
    return {a: b for g in groups for a, b in zip(g, g[1:] + g[:1], strict=True)}


def features(word: str) -> list[int]:
    """Numbers of a lower-case word and of its beginnings."""
    own = [zlib.crc32(word.encode("utf-8", "replace"))]
    return own + [zlib.crc32(f"{word[:n]}*".encode("utf-8", "replace")) for n in PREFIXES if len(word) > n]


def text_features(text: str | None, swap: dict[str, str] | None = None) -> np.ndarray:
    """Distinct features of a text; with swap, of its counterfactual."""
    words = set(_WORD.findall((text or "").lower()))
    if swap:
        words = {swap.get(w, w) for w in words}
    return np.unique(np.array([x for w in words for x in features(w)], np.uint32))


@dataclass
class Model:
    bias: float
    weights: dict[int, float]
    known: dict[str, list[int]] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        """Probability of toxicity of one text."""
        z = self.bias + sum(self.weights.get(int(x), 0.0) for x in text_features(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def scores(self, texts: list[str]) -> np.ndarray:
        """score() of many texts: only words whose features have weight are looked at."""
        words, code, at = split_words(texts)
        found = [self.weighted(w) for w in words]
        n = np.array([len(f) for f in found], np.int64)
        hit = (n[code] > 0).nonzero()[0]
        doc = np.searchsorted(at, hit, side="right") - 1
        flat = np.array([x for f in found for x in f], np.int64)
        pairs = np.repeat(doc, n[code[hit]]) << 32 | flat[ragged(np.cumsum(n) - n, n, code[hit])]
        pairs = np.unique(pairs)
        weight = np.array([self.weights[x] for x in (pairs & 0xFFFFFFFF).tolist()], float)
        z = self.bias + np.bincount(pairs >> 32, weight, len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def weighted(self, word: str) -> list[int]:
        """Features with a weight of a word with its punctuation."""
        found = self.known.get(word)
        if found is None:
            found = [x for w in _WORD.findall(word.lower()) for x in features(w) if x in self.weights]
            if len(self.known) >= _CACHE:
                self.known.clear()
            self.known[word] = found
        return found


class Rows:
    """Sparse rows of 0, 1 (or +1, -1): products with a weight vector and back."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]) -> None:
        self.row, self.column, self.value, self.shape = row.astype(np.int32), column.astype(np.int32), value, shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.shape[1])


def fit(
    texts: list[np.ndarray],
    swapped: list[np.ndarray | None],
    toxic: np.ndarray,
    evidence: float = EVIDENCE,
    counterfactual: float = COUNTERFACTUAL,
    vocabulary: int = VOCABULARY,
    steps: int = STEPS,
) -> Model:
    """Proximal gradient descent with momentum on the regularised logistic loss.

    texts: features of each document; swapped: those of its counterfactual, None if it has
    no identity term. Without both labels among the documents the score is their share.
    """
    y = np.asarray(toxic, float)
    if len(y) == 0 or y.min() == y.max():
        return Model(0.0 if len(y) == 0 else 30.0 * (2 * y[0] - 1), {})
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    names, column = np.unique(np.concatenate([np.empty(0, np.uint32), *texts]), return_inverse=True)
    df = np.bincount(column, minlength=len(names))
    tells = np.abs(np.bincount(column, y[row] - y.mean(), len(names)))
    tells[df < LEAST_DOCS] = -1
    use = np.sort(np.argsort(-tells, kind="stable")[: min(vocabulary, int((tells >= 0).sum()))])
    place = np.full(len(names), -1)
    place[use] = np.arange(len(use))
    names, keep = names[use], place[column] >= 0
    x = Rows(row[keep], place[column[keep]], np.ones(int(keep.sum())), (len(texts), len(names)))
    pairs = [(a, b) for a, b in zip(texts, swapped, strict=True) if b is not None]
    row, column, value = [], [], []
    for i, (a, b) in enumerate(pairs):
        for part, sign in ((np.setdiff1d(a, b), 1.0), (np.setdiff1d(b, a), -1.0)):
            at = np.searchsorted(names, part)
            at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == part)] if len(names) else at[:0]
            row += [i] * len(at)
            column += at.tolist()
            value += [sign] * len(at)
    d = Rows(np.array(row, int), np.array(column, int), np.array(value), (len(pairs), len(names)))

    # The rarer label counts for more, by the root of how much rarer it is.
    weigh = np.where(y > 0, np.sqrt((1 - y.mean()) / y.mean()), 1.0)
    n, m = weigh.sum(), max(len(pairs), 1)
    l1 = evidence / n

    def gradient(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        r = weigh * (1 / (1 + np.exp(-np.clip(x.times(w) + bias, -30, 30))) - y)
        return x.back(r) / n + counterfactual * d.back(d.times(w)) / m, r.sum() / n

    # The largest curvature, by power iteration, is the inverse of the step.
    v, top = np.ones(len(names)), 1.0
    for _ in range(20):
        u = x.back(weigh * x.times(v)) / (4 * n) + counterfactual * d.back(d.times(v)) / m
        top = np.linalg.norm(u) or 1.0
        v = u / top
    step = 1 / (1.1 * top + 0.25)
    w, bias = np.zeros(len(names)), float(np.log(y.mean() / (1 - y.mean())))
    ahead, ahead_bias, t = w, bias, 1.0
    for _ in range(steps):
        g, gb = gradient(ahead, ahead_bias)
        z = ahead - step * g
        new, new_bias = np.maximum(z - step * l1, 0), ahead_bias - step * gb
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    used = w.nonzero()[0]
    return Model(float(bias), dict(zip(names[used].tolist(), w[used].tolist(), strict=True)))


def fold(doc_id) -> object:
    """CRC-32 of doc_id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    groups=IDENTITY,
    counterfactual: float = COUNTERFACTUAL,
) -> Model:
    """Fits the model on at most `sample` labelled rows outside the held-out fold.

    Only their features come to the driver. The sample is drawn by a hash of doc_id; a
    doc_id with several labels counts as toxic if any says so, and one with several texts
    gives its smallest. Labels that are null or without a text are passed over.
    """
    swap = swaps(groups)
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .where(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            named = [not swap.keys().isdisjoint(_WORD.findall(t.lower())) for t in f["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": f["doc_id"],
                    "label": f["label"],
                    "own": [text_features(t).astype(np.int64) for t in f["text"]],
                    "other": [
                        text_features(t, swap).astype(np.int64) if x else None
                        for t, x in zip(f["text"], named, strict=True)
                    ],
                }
            )

    # The chosen ids are at most `sample` rows: a proven bound for the broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = texts.mapInPandas(each, "doc_id long, label int, own array<long>, other array<long>")
    rows = rows.toArrow().to_pandas().sort_values("doc_id")
    as_features = lambda x: None if x is None else np.asarray(x, np.uint32)
    return fit(
        [as_features(x) for x in rows["own"]],
        [as_features(x) for x in rows["other"]],
        rows["label"].to_numpy() > 0,
        counterfactual=counterfactual,
    )


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column toxicity, the model's probability for each row's whole text.

    Null and empty texts get the score of a text without words. Repeated rows are scored
    alike; no rows give no rows. A column of docs called toxicity is replaced. A text of any
    length is read whole by one task.
    """
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            texts = texts.fillna("").tolist()
            parts = [sent.value.scores(texts[a:b]) for a, b in slices(texts)]
            yield pd.Series(np.concatenate([np.empty(0), *parts]))

    return docs.withColumn("toxicity", scored(F.col("text")))
