"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector, ordered thresholds. A text's features
are its distinct words and their beginnings, hashed. The model is fitted on a bounded sample of
labelled documents; scoring reads every whole text and needs no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

_EDGE = re.compile(r"[\W\d_]+")
GRADES = 4


def word_features(word: str) -> list[int]:
    """Hashes of a word (letters only, lower case) and of its first 4, 5 and 6 letters."""
    import xxhash

    w = _EDGE.sub("", word)
    parts = [f"w {w}"] + [f"{k} {w[:k]}" for k in (4, 5, 6) if len(w) > k] if w else []
    return [h - (1 << 64) if (h := xxhash.xxh3_64_intdigest(p)) >> 63 else h for p in parts]


@dataclass
class Ordinal:
    """weights by feature; thresholds in ascending order, one fewer than the grades."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [8.0, 9.0, 10.0])

    def severities(self, scores):
        """Expected grade, and the probability of a grade above 0, by score."""
        import numpy as np

        over = 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - np.asarray(scores)[:, None], -500, 500)))
        return over.sum(axis=1), over[:, 0]


def fit_ordinal(rows: list, grades: list[int], n_features: int, steps: int = 250, rate: float = 0.1, l2: float = 2e-4):
    """Weights and thresholds by Adam on the mean log likelihood. rows: feature numbers per document;
    thresholds are a first one and positive gaps, so they stay in order."""
    import numpy as np

    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(doc) else np.zeros(0, np.int64)
    y, k = np.asarray(grades), GRADES - 1
    x = np.concatenate([np.zeros(n_features), [2.0], np.full(k - 1, 0.0)])
    m, s = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, first, gaps = x[:n_features], x[n_features], np.exp(x[n_features + 1 :])
        cuts = np.concatenate([[-np.inf], first + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(doc, weights=w[feat], minlength=len(rows))
        hi, lo = (1 / (1 + np.exp(np.clip(-(c - score), -500, 500))) for c in (cuts[y + 1], cuts[y]))
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p  # derivatives by the upper and lower cut
        g_cut = np.zeros(k)
        np.add.at(g_cut, y[y < k], -dhi[y < k])
        np.add.at(g_cut, y[y > 0] - 1, dlo[y > 0])
        g = np.concatenate(
            [np.bincount(feat, weights=(dhi - dlo)[doc], minlength=n_features) / len(y) + l2 * w, [g_cut.sum() / len(y)], [g_cut[j + 1 :].sum() * gaps[j] / len(y) for j in range(k - 1)]]
        )
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    first, gaps = x[n_features], np.exp(x[n_features + 1 :])
    return x[:n_features], [float(first + d) for d in np.concatenate([[0], np.cumsum(gaps)])]


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, most_features: int = 4096) -> Ordinal:
    """Fit on at most `sample` labelled documents (a documented bound: those with the smallest hash of
    the id; of rows with one id that with the smallest hash of its text) and the most_features features that tell toxic from clean best.

    Labels are 0 or 1. A toxic document's grade 1 to 3 is its third of the toxic ones by how many
    of its words have a telling feature. Without labels of both kinds the model finds nothing."""
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    held = docs.select("doc_id", common.text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    # of rows with one id a single text counts, so no more than `sample` rows come of it
    texts = held.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches):
        import pyarrow as pa

        known = tokens.Chunks(lambda ws: [word_features(w) for w in ws])
        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                words = set(text.lower().split())
                all_ = known.ensure(words)
                out.append(sorted({f for w in words for f in all_[w]}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "toxic", "features"])

    kinds = dict(docs.dtypes)["doc_id"], dict(labels.dtypes)["toxic"]
    rows = common.stash(texts.mapInArrow(features, f"doc_id {kinds[0]}, toxic {kinds[1]}, features array<long>"), "features")
    sizes = {bool(r["t"]): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    yes, no = sizes.get(True, 0), sizes.get(False, 0)
    if not yes or not no:
        return Ordinal()
    by = rows.select(F.explode("features").alias("f"), (F.col("toxic") > 0).cast("int").alias("t")).groupBy("f").agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b"))
    rate = (F.col("a") + F.col("b")) / (yes + no)
    z = (F.col("a") / yes - F.col("b") / no) / F.sqrt(rate * (1 - rate) * (1 / yes + 1 / no) + 1e-12)
    best = by.where("a + b >= 4").withColumn("z", z).where("abs(z) >= 4").orderBy(F.desc(F.abs("z")), "f").limit(most_features).collect()
    place = {r["f"]: i for i, r in enumerate(best)}
    telling = {place[r["f"]] for r in best if r["z"] > 0 and r["a"] * no > 10 * (r["b"] + 1) * yes}
    table = F.array(*(F.lit(f) for f in place)) if place else F.array().cast("array<long>")
    kept = rows.select("doc_id", "toxic", F.array_intersect("features", table).alias("features")).orderBy("doc_id").collect()
    found = [[place[f] for f in r["features"]] for r in kept]
    hits = [sum(f in telling for f in x) for x in found]
    ranks = sorted(h for h, r in zip(hits, kept, strict=True) if r["toxic"] > 0)
    cuts = [ranks[len(ranks) // 3], ranks[2 * len(ranks) // 3]]
    grades = [1 + sum(h > c for c in cuts) if r["toxic"] > 0 else 0 for h, r in zip(hits, kept, strict=True)]
    weights, thresholds = fit_ordinal(found, grades, len(place))
    return Ordinal({f: float(weights[i]) for f, i in place.items()}, thresholds)


def score_toxicity(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, severity double (expected grade, 0 to 3), p_toxic double, toxic boolean (p_toxic at
    least a half). Very long texts are read whole. Null or empty texts score as without features; ids may repeat or be null; other
    columns are not read; an empty table gives none."""
    kind = dict(docs.dtypes)[id_col]

    def score(batches):
        import pyarrow as pa

        get = model.weights.get
        # a word counts for each feature once, as in training, so a text's features are a set
        known = tokens.Chunks(lambda ws: [tuple(f for f in word_features(w) if f in model.weights) for w in ws], 400_000)
        for b in batches:
            scores = []
            for text in b.column(1).to_pylist():
                words = set(text.lower().split())
                all_ = known.ensure(words)
                scores.append(sum(map(get, sorted(set().union(*filter(None, map(all_.__getitem__, words)))))))
            e, p = model.severities(scores)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e, pa.float64()), pa.array(p, pa.float64()), pa.array(p >= 0.5)], names=[id_col, "severity", "p_toxic", "toxic"])

    return docs.select(F.col(id_col), common.text_of(text_col).alias("_text")).mapInArrow(score, f"{id_col} {kind}, severity double, p_toxic double, toxic boolean")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all documents, by a model of the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
