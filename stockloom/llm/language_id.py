"""Language of whole texts: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .linear import collected, labelled_sample, sigmoid, svm
from .ngrams import chunks, grams, plain

#: Families of language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
ORDERS, BITS = (1, 2, 3, 4), 15


def family(lang: str) -> str:
    code = re.split(r"[-_]", lang.lower())[0]
    return next((f for f, codes in FAMILIES.items() if code in codes), f"only:{lang}")


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and shares: of each order's n-grams, the part that a bucket has."""
    buf = np.frombuffer(plain(text), np.uint8)
    at, value = [], []
    for o, n in enumerate(ORDERS):
        h, c = np.unique(grams(buf, n, BITS), return_counts=True)
        at.append(h.astype(np.int64) + (o << BITS))
        value.append(c / max(1, c.sum()))
    return np.concatenate(at), np.concatenate(value)


@dataclass
class Model:
    """columns: weights of all SVMs side by side. families: name -> its languages. columns of `family_pairs` and
    `pairs`: (first, second) -> number; a positive margin speaks for the first."""

    weights: np.ndarray
    bias: np.ndarray
    families: dict[str, list[str]]
    family_pairs: dict[tuple[str, str], int]
    pairs: dict[tuple[str, str], int]

    def _vote(self, names: list[str], pairs: dict, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the duels of each text, and its least probability against another. Ties of votes go to the larger sum of margins."""
        if len(names) == 1:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        votes, total = np.zeros((2, len(margins), len(names)))
        least = np.ones((len(margins), len(names)))
        for (a, b), col in pairs.items():
            i, j, m = names.index(a), names.index(b), margins[:, col]
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            total[:, i] += m
            total[:, j] -= m
            least[:, i] = np.minimum(least[:, i], sigmoid(2.0 * m))
            least[:, j] = np.minimum(least[:, j], sigmoid(-2.0 * m))
        best = (votes + 0.5 * np.tanh(total / len(names))).argmax(axis=1)
        return best, np.take_along_axis(least, best[:, None], axis=1)[:, 0]

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        lang = np.full(len(texts), "und", object)
        score = np.zeros(len(texts))
        if not self.families:
            return lang.tolist(), score
        names = list(self.families)
        for s, e, buf, sizes in chunks(texts):
            margins = np.tile(self.bias, (e - s, 1))
            starts = np.append(0, np.cumsum(sizes)[:-1])
            for o, n in enumerate(ORDERS):
                h = grams(buf, n, BITS)
                for col in range(self.weights.shape[1]):
                    got = self.weights[o << BITS : (o + 1) << BITS, col][h]
                    got = np.append(got, np.zeros(n - 1, got.dtype))
                    for k in range(1, n):  # n-grams that cross into the next text
                        got[np.cumsum(sizes) - k] = 0
                    margins[:, col] += np.add.reduceat(got, starts, dtype=np.float64) / np.maximum(1, sizes - n + 1)
            best, p = self._vote(names, self.family_pairs, margins)
            for f, name in enumerate(names):
                rows = np.flatnonzero(best == f)
                langs = self.families[name]
                inside = {k: v for k, v in self.pairs.items() if k[0] in langs}
                who, q = self._vote(langs, inside, margins[rows])
                lang[s + rows] = np.array(langs, object)[who]
                score[s + rows] = p[rows] * q
        for i, t in enumerate(texts):
            if not t or not any(map(str.isalpha, t)):  # numbers that are letters by another name, as ½ or Ⅷ, are none
                lang[i], score[i] = "und", 0.0
        return lang.tolist(), score


def train(docs: DataFrame, per_language: int = 1200) -> Model:
    """docs: doc_id, text, lang. A sample of about `per_language` texts of each language comes to the driver."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    frame = collected(labelled_sample(rows, "lang", per_language))
    langs = sorted(frame["lang"].unique()) if len(frame) else []
    families: dict[str, list[str]] = {}
    for x in langs:
        families.setdefault(family(x), []).append(x)
    families = dict(sorted(families.items()))
    dims = len(ORDERS) << BITS
    data = [_counts(t) for t in frame["text"]] if len(frame) else []
    mean = np.full(dims, 1e-7)
    for at, v in data:
        mean[at] += v / len(data)
    scale = 1.0 / np.sqrt(mean + 1e-5)
    data = [(at, v * scale[at]) for at, v in data]
    tag = frame["lang"].to_numpy() if len(frame) else np.array([])
    fam = np.array([family(x) for x in tag])
    columns, bias, family_pairs, pairs = [], [], {}, {}

    def duel(kind, a, b, of):
        rows = np.flatnonzero((of == a) | (of == b))
        w, c = svm([data[i] for i in rows], np.where(of[rows] == a, 1.0, -1.0), dims)
        kind[(a, b)] = len(columns)
        columns.append((w * scale).astype(np.float32))
        bias.append(c)

    for a, b in combinations(families, 2):
        duel(family_pairs, a, b, fam)
    for members in families.values():
        for a, b in combinations(members, 2):
            duel(pairs, a, b, tag)
    weights = np.column_stack(columns) if columns else np.zeros((dims, 0), np.float32)
    return Model(np.asfortranarray(weights), np.array(bias), families, family_pairs, pairs)


def predict_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row per row, no shuffle. `und` with score 0 for a text that is null or has no
    letter, and for all texts if there was nothing to learn from."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages, not by data

    def run(batches):
        for b in batches:
            lang, score = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, held: int = 0, per_language: int = 1200) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from the rows outside fold `held`; null languages teach nothing."""
    model = train(docs.where(fold() % folds != held), per_language)
    return predict_language(docs, model).select("doc_id", (fold() % folds == held).alias("held_out"), "lang_pred", "score")
