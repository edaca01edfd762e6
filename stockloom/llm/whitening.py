"""Whitening of embeddings: exact moments of distinct vectors, leading components by spectrum slicing."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .spectrum import leading
from .vectors import finite, lists, longest, matrix

#: Scaled components further out are taken as this.
LIMIT = (1 << 31) - 1
_WHOLE = pa.decimal128(38, 0)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers. A constant added to all of them changes no difference to a mean, so none is added."""
    return np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype(np.int64)


def _rounded(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([lists(whole(matrix(b.column(0), dims), scale).astype(np.int32))], names=["x"])

    return run


def _totals(dims: int):
    """Of a task: the number of vectors at i = -1, and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, object), 0
        for b in batches:
            x = matrix(b.column(0), dims)
            total, n = total + x.astype(np.int64).sum(axis=0).astype(object), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([Decimal(int(v)) for v in (n, *total)], _WHOLE)], names=["i", "s"])

    return run


def products(z: np.ndarray, rows: int = 4096) -> np.ndarray:
    """zᵀz, exact, as Python numbers. Products are taken of halves of 16 bits, so that doubles hold their sums."""
    out = np.zeros((z.shape[1], z.shape[1]), object)
    for s in range(0, len(z), rows):
        part = z[s : s + rows]
        if np.abs(part).max(initial=0) < 1 << 20:
            f = part.astype(float)
            out += (f.T @ f).astype(np.int64).astype(object)
        else:
            high, low = (part >> 16).astype(float), (part & 0xFFFF).astype(float)
            cross = (high.T @ low).astype(np.int64).astype(object)
            out += (high.T @ high).astype(np.int64).astype(object) * (1 << 32) + (cross + cross.T) * (1 << 16) + (low.T @ low).astype(np.int64).astype(object)
    return out


def _products(centre: np.ndarray):
    """Of a task: sums of products of centred components, i <= j."""
    dims = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for b in batches:
            total = total + products(matrix(b.column(0), dims).astype(np.int64) - centre[None, :])
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([Decimal(int(v)) for v in total[i, j]], _WHOLE)], names=["i", "j", "s"])

    return run


class Moments:
    """n vectors, sums by dimension (exact) and the covariance, whose entries are exact quotients rounded once."""

    def __init__(self, fit: DataFrame, dims: int):
        self.dims = dims
        found = {r.i: int(r.s) for r in fit.mapInArrow(_totals(dims), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
        self.n, self.sums = found.get(-1, 0), [found.get(i, 0) for i in range(dims)]
        n = max(self.n, 1)
        self.centre = np.array([s // n for s in self.sums], np.int64)
        self.rest = [s % n for s in self.sums]  # sums of the centred components, each in [0, n)
        rest = np.array(self.rest, object)
        moment = np.zeros((dims, dims), object)
        for r in fit.mapInArrow(_products(self.centre), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
            moment[r.i, r.j] = moment[r.j, r.i] = int(r.s)
        exact = n * moment - np.outer(rest, rest)
        self.covariance = np.array([[int(e) / (n * n) for e in row] for row in exact], float).reshape(dims, dims)
        self.trace = int(sum(exact[i, i] for i in range(dims))) / (n * n)


class Whitener:
    """Projects centred vectors on the leading components, each over the root of its eigenvalue."""

    def __init__(self, moments: Moments, most: int):
        self.n, self.dims, self.centre, self.rest = moments.n, moments.dims, moments.centre, moments.rest
        self.values, vectors = leading(moments.covariance, most)
        self.axes = vectors / np.sqrt(self.values)[None, :]
        self.mean = np.array([r / max(self.n, 1) for r in self.rest])
        self.explained = [float(e / moments.trace) for e in self.values]

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (z - self.mean[None, :]) @ self.axes

    def deviations(self, z: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)², exact; null where a long cannot hold it."""
        rest, far = np.array(self.rest, object), int(np.abs(z).max(initial=0))
        small = far * max(far, self.n) * max(1, self.dims) < 1 << 62
        z = z if small else z.astype(object)
        squares, cross = (z * z).sum(axis=1), z @ (rest.astype(np.int64) if small else rest)
        own = int((rest * rest).sum()) if self.dims else 0
        exact = (self.n * self.n * int(q) - 2 * self.n * int(t) + own for q, t in zip(squares, cross, strict=True))
        return [d if d < 1 << 63 else None for d in exact]


def _spread(w: Whitener):
    """Of a task: sums of whitened values (j = -1) and of their products, i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        one, two = np.zeros(k), np.zeros((k, k))
        for b in batches:
            y = w.whitened(matrix(b.column(0), w.dims).astype(np.int64) - w.centre[None, :])
            one, two = one + y.sum(axis=0), two + y.T @ y
        i, j = np.triu_indices(k)
        at = [np.append(np.arange(k), i).astype(np.int32), np.append(np.full(k, -1), j).astype(np.int32), np.append(one, two[i, j])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in at], names=["i", "j", "s"])

    return run


def identity_error(fit: DataFrame, w: Whitener) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, measured on its rows."""
    k, n = len(w.values), max(w.n, 1)
    one, two = np.zeros(k), np.zeros((k, k))
    sums = fit.mapInArrow(_spread(w), "i int, j int, s double").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,18)")).alias("s"))  # decimals: the order of tasks does not matter
    for r in sums.collect():
        if r.j < 0:
            one[r.i] = float(r.s) / n
        else:
            two[r.i, r.j] = two[r.j, r.i] = float(r.s) / n
    return float(np.abs(two - np.outer(one, one) - np.eye(k)).max(initial=0))


def _applied(w: Whitener, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = whole(matrix(b.column(1), w.dims), scale) - w.centre[None, :]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.deviations(z), pa.int64()), lists(w.whitened(z))], names=["vec_id", "deviation", "whitened"])

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and leading component.

    Components of vectors become floor(scale * c); the covariance is that of the distinct vectors, from sums of centred whole numbers
    that are exact. Vectors that are null or hold null or non-finite components are dropped; shorter ones are filled up with zeros to the
    longest; scaled components beyond 2^31 are taken as that. Repeated rows have equal results, each its own; ids are not looked at. Components
    whose eigenvalue rounding cannot tell from zero are left out, so one distinct vector, or an empty table, gives no rows.

    Distinct vectors are gathered in the reading tasks before they travel, so a vector that fills a third of the table sends one row a task.
    Tasks return sums of dims * dims numbers; the driver sees those alone, whatever the number of rows, and finds the components.
    """
    usable = rows.where(finite(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    dims = longest(usable, "vector")
    fit, folder = written(usable.select("vector").mapInArrow(_rounded(dims, scale), "x array<int>").distinct(), "fit")
    w = Whitener(Moments(fit, dims), components)
    error = identity_error(fit, w)
    discard(rows.sparkSession, folder)
    out = usable.mapInArrow(_applied(w, scale), "vec_id long, deviation long, whitened array<double>").select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    explained = F.array(*[F.lit(x) for x in w.explained]) if w.explained else F.array(F.lit(0.0))
    return out.select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("_at")].alias("explained"), F.lit(error).alias("identity_error"))
