"""The classifier: held-out accuracy, counterfactual scores, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from muster.llm import toxicity

SF = "/root/testdata/sf0.01"


def documents(n=600, seed=5):
    """Half of the toxic texts name one group, few of the clean ones do."""
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(200)]
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        text = list(rng.choice(words, 30))
        if toxic and rng.random() < 0.9:
            text.append("nasty")
        if rng.random() < (0.8 if toxic else 0.02):
            text.append("muslims")
        out.append((" ".join(text), toxic))
    return out


def fitted(counterfactual):
    docs, swap = documents(), toxicity.swaps()
    own = [toxicity.text_features(t) for t, _ in docs]
    other = [toxicity.text_features(t, swap) if "muslims" in t else None for t, _ in docs]
    return toxicity.fit(own, other, np.array([x for _, x in docs]), counterfactual=counterfactual)


def test_penalty_lowers_scores_of_neutral_mentions():
    free, held = fitted(0.0), fitted(50.0)
    neutral = "word1 word2 muslims word3"
    gap = [m.score(neutral) - m.score(neutral.replace("muslims", "hindus")) for m in (free, held)]
    assert gap[0] > 0.3 and abs(gap[1]) < 0.01
    assert free.score(neutral) > 0.5 > 2 * held.score(neutral)
    assert held.score("word1 nasty word2") > 0.5 > held.score("word1 word2")


def test_many_texts_score_as_one_by_one():
    model = fitted(5.0)
    texts = ["Nasty, word1!", "", "nasty nasty nasty", "a\n\tb  nasty.", "naïve Nasty\x00", "word " * 5000]
    assert model.scores(texts) == pytest.approx([model.score(t) for t in texts], abs=1e-12)
    assert model.score(None) == model.score("")


def test_one_label_only():
    one = toxicity.fit([np.array([1], np.uint32)] * 3, [None] * 3, np.ones(3))
    assert one.score("x") > 0.5
    assert toxicity.fit([], [], np.array([])).score("x") == 0.5


def test_swaps_stay_in_their_group():
    swap = toxicity.swaps()
    for group in toxicity.IDENTITY:
        assert {swap[x] for x in group} == set(group) and all(swap[x] != x for x in group)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert model.weights and min(model.weights.values()) > 0
    scored = toxicity.score(spark, docs, model).join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0)
    rows = [(r.toxic, r.toxicity >= 0.5) for r in scored.select("toxic", "toxicity").collect()]
    assert sum(p for y, p in rows if not y) <= 2
    assert sum(y == p for y, p in rows) / len(rows) > 0.93


def test_odd_rows(spark):
    schema = "doc_id long, text string, toxicity string"
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "fine", None)], schema)
    labels = spark.createDataFrame([(1, 0, None), (2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(spark, docs, model).collect()
    assert len(rows) == 4 and all(0 <= r.toxicity <= 1 for r in rows)
    empty = toxicity.score(spark, docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0)))
    assert empty.count() == 0
