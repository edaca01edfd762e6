"""Quality by compression: a text is good if a dictionary of good texts shortens it more than one of bad texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .linear import sigmoid
from .toxicity import labelled

LEVEL = 3
#: Bytes that are compressed at a time. All blocks of a text count; one alone would learn from the text itself and
#: let the dictionaries matter less the longer the text is.
BLOCK = 1024


@dataclass
class Model:
    """good, bad: dictionaries. slope, level: the calibration, a logistic curve of the difference."""

    good: bytes
    bad: bytes
    slope: float
    level: float

    def _tools(self):
        import zstandard as z

        if not hasattr(self, "_made"):
            params = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
            kind = z.DICT_TYPE_AUTO
            self._made = []
            for d in (self.good, self.bad):
                known = z.ZstdCompressionDict(d, dict_type=kind) if d else None
                if known:
                    known.precompute_compress(compression_params=params)
                self._made.append(z.ZstdCompressor(compression_params=params, dict_data=known) if known else z.ZstdCompressor(compression_params=params))
        return self._made

    def difference(self, text: str | None) -> float:
        """Bytes saved by the good dictionary over the bad one, per byte of text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        good, bad = self._tools()
        saved = 0
        for at in range(0, max(1, len(raw)), BLOCK):
            block = raw[at : at + BLOCK]
            saved += len(bad.compress(block)) - len(good.compress(block))
        return saved / max(1, len(raw))

    def score(self, texts: list) -> np.ndarray:
        d = np.array([self.difference(t) for t in texts])
        return sigmoid(self.slope * d + self.level)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}


def _dictionary(texts: list[str], size: int) -> bytes:
    import zstandard as z

    pieces = [t.encode("utf-8", "surrogatepass") for t in texts]
    pieces = [p[i : i + 4096] for p in pieces for i in range(0, len(p), 4096)]
    try:
        return z.train_dictionary(size, pieces, level=LEVEL, threads=0).as_bytes()
    except z.ZstdError:  # too few samples to train on: their text itself is the dictionary
        return b"".join(pieces)[-size:]


def train(texts: list, y: np.ndarray, size: int = 112_640) -> Model:
    """texts and labels 0 or 1 of a bounded sample. Two thirds make the dictionaries, the rest the calibration."""
    if not len(y) or y.min() == y.max():
        return Model(b"", b"", 0.0, 0.0 if not len(y) else 20.0 if y[0] else -20.0)
    build = np.arange(len(y)) % 3 != 2
    if y[build].min() == y[build].max() or build.all() or y[~build].min() == y[~build].max():
        build[:] = True
    model = Model(*(_dictionary([t for t, k, b in zip(texts, y, build, strict=True) if b and k == want], size) for want in (1, 0)), 0.0, 0.0)
    rest = ~build if not build.all() else build
    d = np.array([model.difference(t) for t, r in zip(texts, rest, strict=True) if r])
    model.slope, model.level = _calibrate(d, y[rest])
    return model


def _calibrate(d: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and level of the logistic curve closest to the labels, both classes weighing alike, so that one half is where a text is as likely
    of either if both were as common. Labels are drawn in by one text a class, so the curve stays finite where classes do not touch. It rises everywhere: scores keep the order of differences."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1.0) / (good + 2.0), 1.0 / (bad + 2.0))
    weight = np.where(y == 1, 0.5 / max(1, good), 0.5 / max(1, bad))
    middle, wide = float(np.median(d)), float(d.std()) or 1.0
    x = np.stack([(d - middle) / wide, np.ones(len(d))], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - target)) + 1e-6 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-10:
            break
    if w[0] <= 0:
        return 0.0, 0.0  # the dictionaries tell nothing
    return float(w[0] / wide), float(w[1] - w[0] * middle / wide)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row per row, no shuffle. Null and empty texts have the score of no difference."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def run(batches):
        for b in batches:
            score = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, per_class: int = 2000) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns from labels outside fold `held`."""
    model = train(*labelled(docs, labels, "quality", fold() % folds != held, per_class))
    return score_quality(docs, model).select("doc_id", (fold() % folds == held).alias("held_out"), "score", "predicted")
