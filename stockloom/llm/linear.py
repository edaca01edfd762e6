"""Small linear learners and sampling of labelled rows, for models that are trained on the driver.

Only bounded samples come to the driver; every corpus row is scored on executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SIDE, broadcast_if_under


def labelled_sample(rows: DataFrame, group: str, per_group: int, key: str = "doc_id") -> DataFrame:
    """About `per_group` rows of each value of `group` (all, if there are fewer), picked by a hash of the key.

    The counts that set the rates cover all rows. The same rows give the same sample, however they are partitioned.
    """
    part = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(17)), 11) / F.lit(float(1 << 53))
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    counts = broadcast_if_under(counts, SMALL_SIDE)  # one row a group
    return rows.join(counts, group).where(part < F.lit(float(per_group)) / F.col("_n")).drop("_n")


def collected(sample: DataFrame) -> pd.DataFrame:
    """A bounded sample on the driver, in an order that does not depend on partitions."""
    frame = pd.DataFrame([r.asDict() for r in sample.collect()], columns=sample.columns)
    return frame.sort_values(["doc_id", "text"], kind="stable", ignore_index=True) if len(frame) else frame


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, c: float = 1.0, rounds: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by dual coordinate descent.

    rows: index and value arrays; y: -1 or 1, weighted so that both classes count alike. Returns weights and bias."""
    w = np.zeros(dims + 1)
    rng = np.random.default_rng(seed)
    a = np.zeros(len(rows))
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    d = 1.0 / (2.0 * c / np.maximum(2.0 * share, 1e-9))
    q = np.array([float(v @ v) + 1.0 for _, v in rows]) + d
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[dims]) - 1.0 + d[i] * a[i]
            new = max(a[i] - g / q[i], 0.0)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[at] += step * v
                w[dims] += step
                a[i] = new
    return w[:dims], float(w[dims])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500.0, 500.0)))


def logistic_fit(x: np.ndarray, y: np.ndarray, balance: bool = True, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (last: bias) of a logistic regression on few columns, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    share = np.where(y > 0, max((y > 0).mean(), 1e-9), max((y <= 0).mean(), 1e-9))
    weight = 0.5 / share if balance else np.ones(len(y))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
