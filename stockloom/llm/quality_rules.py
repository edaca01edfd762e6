"""Quality rules whose cutoffs are risk-controlled: exact binomial bounds on labelled holdouts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SIDE, broadcast_if_under, materialize

SYMBOLS = b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: A document fails a rule when its value is above the cutoff.
RULES = ("symbols_per_word", "dup_line_share", "repeat_word_share", "chars_per_word", "words_per_char")
#: The steps of the path, loosest first: the share of the good tuning documents that a rule alone may reject, and by how many doublings of
#: the value its cutoff lies beyond them. Steps with such a margin hold where few documents tune the path.
STEPS = ((0.0, 0.5), (0.0, 0.125), *((x, 0.0) for x in (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01)))
#: Values are counted by 64 bins a doubling; zero is in the lowest one.
_BINS, _ZERO = 64, 2.0**-10


def base_counts(text: str | None, window: int = 5) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    solid = b"".join(words)
    chars = len(solid) - int(np.count_nonzero((np.frombuffer(solid, np.uint8) & 0xC0) == 0x80))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > window:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        key = w[: n - window + 1].copy()
        for i in range(1, window):  # after each step the ids of all longer sequences are dense again
            key = np.unique(key * len(ids) + w[i : n - window + 1 + i], return_inverse=True)[1]
        again = np.bincount(key)[key] > 1
        if again.any():
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            repeated = int(np.count_nonzero(np.cumsum(edge)[:n]))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _stratum(stratum_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum")


def add_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the base counts. Texts stay behind. A null stratum is one of its own."""

    def run(batches):
        for b in batches:
            rows = [base_counts(t.as_py()) for t in b.column(2)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            names = ["doc_id", "stratum", *(x.split()[0] for x in BASE.split(", "))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], names=names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), _stratum(stratum_col), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id long, stratum string, {BASE}")


def base_column(text_col: str = "text") -> Column:
    """The base counts as a struct beside the row: only the text goes to Python, and only counts come back."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [base_counts(t.as_py()) for t in texts]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in BASE.split(", ")])

    counts = F.arrow_udf(run, f"struct<{BASE.replace(' long', ':long')}>").asNondeterministic()  # else a filter on it would count anew
    return counts(F.col(text_col).cast("string"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    w = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / w,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / w,
        "chars_per_word": F.col("word_chars") / w,
        "words_per_char": w / F.greatest(F.col("word_chars"), F.lit(1)),
    }


def upper_bound(errors: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which at most so many errors in n have probability delta."""
    if n <= 0 or errors >= n:
        return 1.0
    lo, hi = errors / n, 1.0
    choose = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(errors + 1)]
    for _ in range(60):
        p = (lo + hi) / 2
        a, b = math.log(max(p, 1e-300)), math.log1p(-min(p, 1 - 1e-16))
        tail = sum(math.exp(c + k * a + (n - k) * b) for k, c in enumerate(choose))
        lo, hi = (p, hi) if tail > delta else (lo, p)
    return hi


def _path(hist: list, steps: tuple[tuple[float, float], ...]) -> list[list[float]]:
    """Cutoffs of each rule at each step, from rows (rule, bin, label, count) of the tuning documents: the least bin edge above
    which lies no more than the step's share of good documents; none where the rule would reject hardly more of the bad."""
    out = []
    for step, margin in steps:
        cuts = []
        for r in range(len(RULES)):
            count = {y: {} for y in (0, 1)}
            for x in hist:
                if x["r"] == r:
                    count[x["y"]][x["bin"]] = x["n"]
            good, bad = sum(count[1].values()), sum(count[0].values())
            above, cut = [0, 0], math.inf
            for edge in sorted({*count[0], *count[1]}, reverse=True):
                if not good or above[1] > step * good:
                    break
                useful = bad and above[0] / bad > 2 * above[1] / good
                cut = 2.0 ** ((edge + 1) / _BINS + margin) - _ZERO if useful else math.inf
                above = [above[y] + count[y].get(edge, 0) for y in (0, 1)]
            cuts.append(cut)
        out.append(cuts)
    return out


def holdout_counts(base: DataFrame, labels: DataFrame, label_col: str = "quality") -> tuple[DataFrame, list[list[float]], int]:
    """Counts by stratum of the labelled documents that each step rejects; the cutoffs of the steps; the last step of use.

    One labelled document in four tunes the path, all strata together, and counts no further; the rest are the holdout. A document
    is one trial in a stratum however many rows it has, with the largest value of each rule among them."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("_y")).where("_y IN (0, 1) AND doc_id IS NOT NULL")
    lab = lab.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    values = rule_values()
    rows = base.where(~base_failed()).join(lab, "doc_id").select("doc_id", "stratum", F.col("_y").alias("y"), *[values[r].alias(r) for r in RULES])
    hold = rows.groupBy("doc_id", "stratum", "y").agg(*[F.max(r).alias(r) for r in RULES])  # numbers only
    hold = materialize(hold.withColumn("tune", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4)) == 0).drop("doc_id"), "holdout")
    bins = F.array(*[F.floor(F.log2(F.col(r) + F.lit(_ZERO)) * F.lit(float(_BINS))).cast("int") for r in RULES])
    hist = hold.where("tune").select("y", F.posexplode(bins).alias("r", "bin")).groupBy("r", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    path = _path([r.asDict() for r in hist.collect()], STEPS)  # some thousand rows at most: bins, not documents
    sums = [F.sum((F.col("y") == y).cast("long")).alias(f"n_{y}") for y in (0, 1)]
    for t, cuts in enumerate(path):
        fails = F.lit(False)
        for r, c in zip(RULES, cuts, strict=True):
            fails = fails | (F.col(r) > F.lit(c))
        sums += [F.sum((fails & (F.col("y") == y)).cast("long")).alias(f"f{t}_{y}") for y in (0, 1)]
    tuned = hold.where("tune").agg(*sums).first()
    gain = [(tuned[f"f{t}_0"] or 0) / max(1, tuned["n_0"] or 0) - (tuned[f"f{t}_1"] or 0) / max(1, tuned["n_1"] or 0) for t in range(len(path))]
    best = max(range(len(path)), key=lambda t: (gain[t], -t))
    return hold.where("NOT tune").groupBy("stratum").agg(*sums), path, best if gain[best] > 0 else -1


def learn_cutoffs(base: DataFrame, labels: DataFrame, risk: float = 0.03, delta: float = 0.05, label_col: str = "quality") -> DataFrame:
    """stratum, one column per rule: the cutoff, or infinity where none is certified; and what the holdout shows:
    n_good, n_bad, bad_rejected, good_rejected, bound (of the false rejection).

    Label 1 is good; labelled documents that the base test passes take part, all of them; a document with several labels has the largest.
    A path of rule sets, each step stricter than the one before in every rule, and its last step of use come from the tuning
    documents. On the holdout of a stratum the steps are tested in that order, all rules together, until the exact binomial upper bound
    (Clopper-Pearson) of the share of good documents rejected is above `risk`; a fixed sequence needs no
    correction. Strata that have enough good documents to certify a step without errors share the error probability `delta` in equal
    parts (Bonferroni; these numbers say nothing of the errors, so that choice costs nothing). So with probability 1 - delta no stratum
    loses more than `risk` of the good documents that pass the base test. Any other stratum is left at the base test: no stratum
    answers for another one. The bound takes documents as independent; exact copies under other ids are trials of their own, so where
    a stratum is full of them it is as sure as its number of different texts. The counts are a few numbers a stratum; bounds are computed on executors.
    """
    counts, path, best = holdout_counts(base, labels, label_col)
    counts = materialize(counts, "strata")
    tested, per = _shares(counts, risk, delta)

    def certify(frames):
        for f in frames:
            rows = []
            for row in f.to_dict("records"):
                level, bound = -1, 0.0
                for t in range(best + 1 if row["n_1"] >= tested else 0):
                    up = upper_bound(int(row[f"f{t}_1"]), int(row["n_1"]), per)
                    if up > risk:
                        break
                    level, bound = t, up
                cuts = path[level] if level >= 0 else [math.inf] * len(RULES)
                rejected = [int(row[f"f{level}_{y}"]) if level >= 0 else 0 for y in (0, 1)]
                rows.append((row["stratum"], *cuts, int(row["n_1"]), int(row["n_0"]), *rejected, bound))
            yield pd.DataFrame(rows, columns=["stratum", *RULES, "n_good", "n_bad", "bad_rejected", "good_rejected", "bound"])

    schema = "stratum string, " + ", ".join(f"{r} double" for r in RULES) + ", n_good long, n_bad long, bad_rejected long, good_rejected long, bound double"
    return counts.mapInPandas(certify, schema)


def _shares(counts: DataFrame, risk: float, delta: float) -> tuple[int, float]:
    """The least number of good documents of a stratum that is tested, and its share of the error probability.

    Without errors a stratum needs log(share) / log(1 - risk) good documents. The number of strata that have as many falls as more of them share,
    so the largest number m of which at least m have enough for a share of delta / m is found by halving: some counts of a table of strata."""

    def need(m):
        return math.ceil(math.log(delta / m) / math.log1p(-risk))

    def able(m):
        return counts.where(F.col("n_1") >= need(m)).count()

    low, high = 1, max(1, able(1))
    while low < high:
        m = (low + high + 1) // 2
        low, high = (m, high) if able(m) >= m else (low, m - 1)
    return need(low), delta / max(1, able(low))


def quality_verdicts(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept is false if the base test fails or a rule's value is above its stratum's certified cutoff. Null
    and empty texts have no words and fail the base test. A stratum with no labelled documents, or too few to certify
    anything, rejects by the base test only. Repeated rows are judged alike;
    null ids have no label but are judged like others. Strata are languages.
    """
    base = materialize(add_base(docs), "base-counts")  # some numbers a document: texts are split once
    cuts = learn_cutoffs(base, labels, **kw)
    cuts = broadcast_if_under(cuts.select("stratum", *RULES), SMALL_SIDE)
    return base.join(cuts, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & _within_cutoffs()).alias("kept")
    )


def _within_cutoffs() -> Column:
    values = rule_values()
    ok = F.lit(True)
    for name in RULES:
        ok = ok & (values[name] <= F.coalesce(F.col(name), F.lit(math.inf)))
    return ok


def kept_documents(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars"), label_col: str = "quality", **kw) -> DataFrame:
    """The rows of docs that quality_verdicts keeps. Cutoffs are learned from the labelled documents, whose texts alone are read
    twice; all texts are counted once beside their rows, which are neither written nor shuffled."""
    known = labels.where(F.col(label_col).cast("int").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(broadcast_if_under(known, SMALL_SIDE), "doc_id", "left_semi")
    cuts = learn_cutoffs(add_base(mine), labels, label_col=label_col, **kw).select("stratum", *RULES)
    rows = docs.select(F.struct(*columns).alias("row"), _stratum("lang"), base_column().alias("base"))
    judged = rows.select("row", "stratum", "base.*").join(broadcast_if_under(cuts, SMALL_SIDE), "stratum", "left")
    return judged.where(~base_failed() & _within_cutoffs()).select("row.*")
