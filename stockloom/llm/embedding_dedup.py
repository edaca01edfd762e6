"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import group_bounds, local_labels, materialize, whole_groups
from .components import connected_components

#: Vectors are hashed as whole numbers, so that every machine and batch size finds the same buckets.
_UNIT, _STEP = 1 << 24, 1 << 12


def agreement(distance: float, width: float) -> float:
    """Probability that a quantised Gaussian projection puts two points of a distance into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, least: float, width: float, recall: float = 0.988, strangers: float = 1.0) -> tuple[int, int]:
    """Tables and projections for n vectors of one label.

    Each further projection separates unrelated vectors (at right angles); tables make up for the pairs at the threshold that it
    separates too, so that `recall` of those is found, and more of closer ones. A bucket meets at most `strangers` unrelated vectors,
    whatever n is. Among the numbers of projections that keep this, the one with the least rows sent is taken: one row a table for the
    bucket, and some 25 times that for the vector if its bucket holds another one. Tables grow about as n to the power of 0.23."""
    near, far = agreement(math.sqrt(2 - 2 * least), width), agreement(math.sqrt(2), width)
    fewest = max(8, math.ceil(math.log(max(1.0, n / strangers)) / -math.log(far)))

    def tables(k):
        return math.ceil(math.log(1 - recall) / math.log1p(-(near**k)))

    best = min(range(fewest, fewest + 24), key=lambda k: tables(k) * (1 + 25 * min(1.0, n * far**k)))
    return tables(best), best


class PStable:
    """`tables` hash tables; a bucket of each is `projections` quantised Gaussian projections of the unit vector.

    With width 2 a pair at cosine 0.93 (distance 0.374) agrees on a projection with probability 0.851, unrelated pairs with 0.49.
    """

    def __init__(self, dims: int, tables: int, projections: int, width: float, seed: int = 1):
        rng = np.random.default_rng([seed, dims])
        self.shape = (tables, projections)
        self.a = np.rint(rng.standard_normal((dims, tables * projections)) * _STEP)  # whole numbers: sums of products are exact in doubles
        self.w = int(width * _UNIT * _STEP)
        self.b = rng.integers(0, self.w, tables * projections)
        self.mix = rng.integers(1, 1 << 62, tables * projections, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One 64-bit bucket number per vector and table."""
        norm = np.zeros(len(x))
        for c in range(x.shape[1]):  # in this order on every machine
            norm = norm + x[:, c] * x[:, c]
        unit = np.rint(x / np.sqrt(norm)[:, None] * _UNIT)
        cell = ((unit @ self.a).astype(np.int64) + self.b) // self.w
        h = (cell.astype(np.uint64) * self.mix).reshape(len(x), *self.shape)
        h ^= h >> np.uint64(29)
        h = (h * np.uint64(0xBF58476D1CE4E5B9)).sum(axis=2, dtype=np.uint64)
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0x94D049BB133111EB) + np.arange(self.shape[0], dtype=np.uint64)).view(np.int64)


@lru_cache(maxsize=8)
def _hashing(dims: int, tables: int, projections: int, width: float) -> PStable:
    return PStable(dims, tables, projections, width)


def usable(vector: str | Column, label: str | Column) -> Column:
    """Label and vector present, all components finite, not all of them zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    lab = F.col(label) if isinstance(label, str) else label
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return lab.isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, and their lengths. Shorter vectors are filled up with zeros."""
    n = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == n[0]).all():
        return flat.reshape(len(n), int(n[0])), n
    out = np.zeros((len(n), int(n.max(initial=1))))
    at = np.append(0, np.cumsum(n))
    for i in range(len(n)):
        out[i, : n[i]] = flat[at[i] : at[i + 1]]
    return out, n


def _buckets(tables: int, projections: int, width: float, rows: int = 1024):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, rows):  # some MB of keys at a time
                b = whole.slice(at, rows)
                x, n = _matrix(b.column(1))
                keys = np.zeros((len(x), tables), np.int64)
                for d in np.unique(n):
                    mine = np.flatnonzero(n == d)
                    keys[mine] = _hashing(int(d), tables, projections, width).keys(x[mine, : int(d)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), lists], names=["rep", "space", "dims", "keys"])

    return run


def _compare(least: float, tables: int, projections: int, width: float):
    def one(t, rep, copies, x, part):
        """Per vector of a cell: the smallest vector it reaches inside the cell, and the sizes of the classes it
        is newly linked to: a pair counts in the first table only in which its buckets agree."""
        norm = np.sqrt((x * x).sum(axis=1))
        linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= least
        np.fill_diagonal(linked, False)
        if part.min() != part.max():
            linked &= part[:, None] != part[None, :]
        i, j = np.nonzero(np.triu(linked))
        if not len(i):
            return None
        fresh = np.ones(len(i), bool)
        if t:
            who = np.unique(np.append(i, j))
            at = np.zeros(len(x), np.int64)
            at[who] = np.arange(len(who))
            keys = _hashing(x.shape[1], tables, projections, width).keys(x[who])[:, :t]
            for s in range(0, len(i), 1 << 16):
                cut = slice(s, s + (1 << 16))
                fresh[cut] = ~(keys[at[i[cut]]] == keys[at[j[cut]]]).any(axis=1)
        i, j = i[fresh], j[fresh]
        links = np.bincount(i, copies[j], minlength=len(x)) + np.bincount(j, copies[i], minlength=len(x))
        low = rep.argsort()
        label = local_labels(linked[np.ix_(low, low)])
        to = np.empty(len(x), np.int64)
        to[low] = rep[low][label]
        some = (links > 0) | (to != rep)
        return rep[some], to[some], links[some].astype(np.int64)

    def run(batches):
        names = ["bucket", "t", "dims", "cell_a", "cell_b"]
        for table in whole_groups(batches, names):
            if table is None:
                continue
            table = table.combine_chunks()
            col = {c: table.column(c).to_numpy() for c in (*names, "rep", "copies", "part")}
            at = group_bounds([col[c] for c in names])
            big = np.flatnonzero(np.diff(at) > 1)
            found = []
            for g in big:
                cut = slice(int(at[g]), int(at[g + 1]))
                x, _ = _matrix(table.column("vector").chunk(0).slice(cut.start, cut.stop - cut.start))
                got = one(int(col["t"][cut.start]), col["rep"][cut], col["copies"][cut], x, col["part"][cut])
                if got is not None:
                    found.append(got)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b", "links"])

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, tables: int | None = None, projections: int | None = None, width: float = 2.0, tile: int = 512) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Only vectors of one label and one length are compared. A vector that is null, zero or has null or non-finite components, or no label,
    links with nothing: no links, its own component, kept. Equal vectors of a label (by a hash of 128 bits) are one class with one
    representative, the smallest id; links to a class count all its ids. Rows that repeat an id count once as a partner. A null id is
    nobody's partner; its component_id is that of its class and it is not kept beside one.

    tables, projections: by default as shape() has them for the label with the most classes. A bucket with more than `tile`
    classes is dealt over pairs of tiles; cells return sums and a spanning forest, never pairs.
    """
    label, vector = F.col(label_col), F.col(vector_col)
    ok = usable(vector_col, label_col)
    src = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), ok.alias("_ok"), F.when(ok, F.xxhash64(label, F.size(vector))).alias("space"),
        F.when(ok, F.xxhash64(label, vector)).alias("d1"), F.when(ok, F.xxhash64(vector, F.lit(7), label)).alias("d2"),
    )
    classes = src.where("_ok AND vec_id IS NOT NULL").groupBy("space", "d1", "d2").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("vector").alias("vector"))
    classes = materialize(classes, "classes")
    if tables is None or projections is None:
        tables, projections = shape(classes.groupBy("space").count().agg(F.max("count")).first()[0] or 1, least, width)
    # Joins are asked to merge: the planner sizes what comes of a list of keys by one key, not by the tables, and vectors by one component, so it would broadcast millions of rows.
    vectors = classes.select("rep", "vector", "copies")
    keys = classes.select("rep", "vector", "space", F.size("vector").alias("dims")).mapInArrow(_buckets(tables, projections, width), "rep long, space long, dims int, keys array<long>")
    keys = keys.select("rep", "dims", "space", F.posexplode("keys").alias("t", "key")).select("rep", "t", "dims", F.xxhash64("key", "space").alias("bucket"))
    crowded = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # a bucket with one vector needs no vector sent
    g = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    part = F.pmod(F.xxhash64("rep", F.lit(11)), g).cast("int")
    cells = keys.join(crowded.hint("merge"), "bucket").select("rep", "t", "dims", "bucket", part.alias("part"), F.explode(F.sequence(F.lit(0), g - 1)).alias("_other"))
    cells = cells.select("rep", "t", "dims", "bucket", "part", F.least("part", "_other").alias("cell_a"), F.greatest("part", "_other").alias("cell_b")).join(vectors.hint("merge"), "rep")
    order = ["bucket", "t", "dims", "cell_a", "cell_b"]
    cells = cells.repartition(*order).sortWithinPartitions(*order)
    found = materialize(cells.mapInArrow(_compare(least, tables, projections, width), "a long, b long, links long"), "found")
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    roots = connected_components(found).withColumnRenamed("node", "rep")
    per_class = classes.select("d1", "d2", "rep", "copies").join(links.hint("merge"), "rep", "left").join(roots.hint("merge"), "rep", "left").select(
        "d1", "d2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    out = src.select("vec_id", "d1", "d2").join(per_class, ["d1", "d2"], "left")  # a row without digest meets none
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
