"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .linear import collected, labelled_sample, logistic_fit, sigmoid, svm
from .ngrams import char_chunks, char_grams, characters

#: Characters of an n-gram, of any script.
ORDERS, BITS = (2, 4, 6), 22


def _present(text: str | None) -> np.ndarray:
    """Buckets of the n-grams that a text has, each once."""
    codes = characters(text)
    return np.unique(np.concatenate([char_grams(codes, n, BITS) for n in ORDERS]))


@dataclass
class Model:
    """weights of the buckets that count; all others have none."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, texts: list) -> np.ndarray:
        if not hasattr(self, "_at"):
            at = np.zeros(1 << BITS, bool)
            at[self.buckets] = True
            self._at = at
        out = np.full(len(texts), self.bias)
        for s, e, codes, sizes in char_chunks(texts):
            ends = np.cumsum(sizes)
            keys = []
            for n in ORDERS:
                h = char_grams(codes, n, BITS)
                hit = np.flatnonzero(self._at[h])
                doc = np.searchsorted(ends, hit, side="right")
                inside = hit + n <= ends[doc]
                keys.append((doc[inside].astype(np.int64) << BITS) | h[hit[inside]])
            found = np.unique(np.concatenate(keys))
            where = np.searchsorted(self.buckets, (found & ((1 << BITS) - 1)).astype(np.uint32))
            out[s:e] += np.bincount(found >> BITS, self.weights[where], minlength=e - s)
        return out

    def score(self, texts: list) -> np.ndarray:
        return sigmoid(self.slope * self.margins(texts) + self.shift)


def train(texts: list, y: np.ndarray, features: int = 20_000, least: int = 3) -> Model:
    """texts and labels 0 or 1 of a bounded sample. Features: the `features` buckets with the largest log-count
    ratio among those of `least` texts or more. Three quarters fit the weights, the rest the calibration."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0, 0.0, 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    docs = [_present(t) for t in texts]
    fit = np.arange(len(y)) % 4 != 3
    if y[fit].min() == y[fit].max():
        fit[:] = True
    counts = np.zeros((2, 1 << BITS), np.float32)
    for d, label in zip([docs[i] for i in np.flatnonzero(fit)], y[fit], strict=True):
        counts[int(label), d] += 1
    n = np.array([(y[fit] == 0).sum(), (y[fit] == 1).sum()])
    ratio = np.log((counts[1] + 0.5) / (n[1] + 1.0)) - np.log((counts[0] + 0.5) / (n[0] + 1.0))
    strength = np.where(counts.sum(axis=0) >= min(least, n.sum()), np.abs(ratio), 0.0)
    top = np.argpartition(-strength, min(features, len(strength) - 1))[:features]
    buckets = np.sort(top[strength[top] > 0]).astype(np.uint32)
    r = ratio[buckets].astype(np.float64)

    def row(d):
        at = np.flatnonzero(np.isin(buckets, d, assume_unique=True))
        return at, r[at]

    rows = [row(d) for d in docs]
    sign = np.where(y == 1, 1.0, -1.0)
    w, b = svm([rows[i] for i in np.flatnonzero(fit)], sign[fit], len(buckets), c=0.05)
    margin = np.array([w[at] @ v + b for at, v in rows])
    rest = ~fit if (~fit).any() and y[~fit].min() != y[~fit].max() else fit
    slope, shift = logistic_fit(margin[rest][:, None], y[rest])
    return Model(buckets, w * r, b, float(slope), float(shift))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, train_fold, per_class: int) -> tuple[list, np.ndarray]:
    """Texts and labels of about `per_class` documents of each label, on the driver. Only labels of the training
    fold are picked from, before any text is read; a document with several labels has the largest, one without text is left out."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    lab = lab.where("doc_id IS NOT NULL AND y IN (0, 1)").where(train_fold).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = F.broadcast(labelled_sample(lab, "y", per_class))  # bounded by per_class
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    frame = collected(rows.where("text IS NOT NULL"))
    return frame["text"].tolist(), frame["y"].to_numpy(dtype=np.int64)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row per row, no shuffle. Null and empty texts have the score of no feature."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by `features`

    def run(batches):
        for b in batches:
            score = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = 2000) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns from labels outside fold `held`. The calibration weighs both
    labels alike: 0.5 is where a text is as likely among the toxic as among the others, whatever their shares in the corpus."""
    model = train(*labelled(docs, labels, "toxic", fold() % folds != held, per_class))
    return score_toxicity(docs, model).select("doc_id", (fold() % folds == held).alias("held_out"), "score", "predicted")
