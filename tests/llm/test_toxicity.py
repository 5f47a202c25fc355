"""Severity: held-out accuracy, order of thresholds, odd tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from keepsake.llm import toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"  # a few of its labels are noise, and its small sibling has too few
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3))
    model = toxicity.train(docs, labels.where(fold != 0))
    assert model.thresholds == sorted(model.thresholds)
    held = labels.where(fold == 0).select("doc_id", F.col("toxic").alias("truth"))
    scored = toxicity.score_toxicity(docs, model).join(held, "doc_id").collect()
    yes, no = [r for r in scored if r.truth], [r for r in scored if not r.truth]
    assert yes and no
    hit = sum(r.p_toxic >= 0.5 for r in yes) / len(yes)
    false = sum(r.p_toxic >= 0.5 for r in no) / len(no)
    assert hit >= 0.9 and false <= 0.02
    assert np.mean([r.severity for r in yes]) > np.mean([r.severity for r in no])


def test_ordinal_fit_recovers_the_order():
    rng = np.random.default_rng(0)
    w = np.array([2.0, -2.0, 0.5, 1.5])
    rows = [np.flatnonzero(rng.random(4) < 0.5) for _ in range(4000)]
    score = np.array([w[r].sum() for r in rows]) + rng.logistic(size=4000)
    grades = np.digitize(score, [0.5, 2.0, 3.5])
    got, cuts = toxicity.fit_ordinal(rows, list(grades), 4, steps=400)
    assert cuts == sorted(cuts) and np.corrcoef(got, w)[0, 1] > 0.97 and abs(cuts[0] - 0.5) < 0.5
    e, p = toxicity.Ordinal({}, cuts).severities([-20.0, 1.0, 20.0])
    assert e[0] < 0.01 < e[1] < 2.99 < e[2] and 0 <= p[0] <= p[1] <= p[2] <= 1


def test_fit_and_scores_are_those_of_plain_loops(spark):
    """The fit reaches the least penalised loss a plain loop can find nearby, and scores are sums over sets."""
    rng = np.random.default_rng(1)
    rows = [[int(f) for f in np.flatnonzero(rng.random(5) < 0.4)] for _ in range(300)]
    grades = [int(g) for g in np.digitize([sum((1.5, -1, 0.5, 2, 0)[f] for f in r) + rng.logistic() for r in rows], [0.0, 1.5, 3.0])]
    l2 = 2e-4

    def loss(weights, cuts):
        total = 0.0
        for r, g in zip(rows, grades, strict=True):
            below = [0.0, *(1 / (1 + math.exp(-(c - sum(weights[f] for f in r)))) for c in cuts), 1.0]
            total -= math.log(max(below[g + 1] - below[g], 1e-12))
        return total / len(rows) + l2 / 2 * sum(w * w for w in weights)

    weights, cuts = toxicity.fit_ordinal(rows, grades, 5, steps=3000, rate=0.02)
    best = loss(weights, cuts)
    for i in range(8):
        for step in (-0.02, 0.02):
            w, c = list(weights), list(cuts)
            if i < 5:
                w[i] += step
            else:
                c[i - 5] += step
            assert loss(w, c) > best - 1e-6

    known = {f: 0.25 * (i + 1) for i, f in enumerate(toxicity.word_features("awfully") + toxicity.word_features("bad"))}
    model = toxicity.Ordinal(known, [0.5, 1.5, 3.0])
    texts = ["awfully bad, BAD!", "awful", "", None, "nothing here", "bad " * 5000 + "awfulness"]
    for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        score = sum(known.get(f, 0.0) for f in {f for w in (texts[r.doc_id] or "").lower().split() for f in toxicity.word_features(w)})
        over = [1 / (1 + math.exp(c - score)) for c in model.thresholds]
        assert abs(r.severity - sum(over)) < 1e-9 and abs(r.p_toxic - over[0]) < 1e-9 and r.toxic == (over[0] >= 0.5)


def test_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (9, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.severity <= 3 for r in rows)
    assert toxicity.score_toxicity(none, model).count() == 0
    empty = toxicity.train(odd, labels.limit(0))
    assert not any(r.toxic for r in toxicity.score_toxicity(odd, empty).collect())
