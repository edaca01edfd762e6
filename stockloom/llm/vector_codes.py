"""Vector codes: product quantisation by Lloyd rounds whose members stay with the owner of their entry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_SIDE, discard, join_spread, materialize, written
from .vectors import finite, lists, longest, matrix

#: Components further out are taken as this, since their squared distances would leave the range of a long.
LIMIT = 1 << 27

#: One part of a vector at the owner of its entry. seed spreads the members of an entry over the salts.
PART = "position int, entry int, salt int, seed int, part array<int>"


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers."""
    return np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of the book (ties to the lower one) and its squared distance; both exact."""
    entry, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < 1 << 53:  # then every step is exact in doubles, in any order
        b = book.astype(np.float64)
        square = (b * b).sum(axis=1)
        for s in range(0, len(x), rows):
            a = x[s : s + rows].astype(np.float64)
            d = square[None, :] - 2 * (a @ b.T)
            entry[s : s + rows] = e = d.argmin(axis=1)
            far[s : s + rows] = d[np.arange(len(a)), e] + (a * a).sum(axis=1)
        return entry, far
    for k, c in enumerate(book):
        d = ((x - c[None, :]) ** 2).sum(axis=1)
        closer = (d < far) if k else np.ones(len(x), bool)
        entry[closer], far[closer] = k, d[closer]
    return entry, far


class Owners:
    """Books, and over how many salts each entry's members are spread: shares of members, so that no owner holds many of them."""

    def __init__(self, books: np.ndarray, counts: np.ndarray, partitions: int):
        self.books = books
        fair = max(500, min(1_000_000, int(counts.sum()) // max(1, 8 * partitions)))
        self.salts = np.maximum(1, -(-counts // fair))

    def salt(self, position: np.ndarray, entry: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return seed % self.salts[position, entry]


def _columns(position, entry, salt, seed) -> list[pa.Array]:
    return [pa.array(np.asarray(c, np.int32)) for c in (position, entry, salt, seed)]


def _counted(books: np.ndarray, scale: int):
    """Members of each entry, a list for each part position and batch of vectors."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, k), np.int64)
        for b in batches:
            x = whole(matrix(b.column(0), parts * width), scale)
            for p in range(parts):
                n[p] += np.bincount(nearest(x[:, p * width : (p + 1) * width], books[p])[0], minlength=k)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e])], names=["position", "entry", "n"])

    return run


def _placed(owners: Owners, scale: int):
    """Vectors cut into parts, each with its first entry."""
    parts, _, width = owners.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(matrix(b.column(0), parts * width), scale)
            seed = np.arange(len(x)) * 40503 % 1_000_003
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                entry, _ = nearest(part, owners.books[p])
                where = np.full(len(x), p)
                yield pa.RecordBatch.from_arrays([*_columns(where, entry, owners.salt(where, entry, seed), seed), lists(part.astype(np.int32))], names=["position", "entry", "salt", "seed", "part"])

    return run


def _sums(shape: tuple[int, int, int]):
    """What a task's resident members add to the entries of its owners: count and sums, one row an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = shape
        total, n = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for b in batches:
            at = b.column(0).to_numpy().astype(np.int64) * k + b.column(1).to_numpy()
            x = matrix(b.column(2), width).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, first = np.unique(at[order], return_index=True)
            if len(at):
                total[at] += np.add.reduceat(x[order], first, axis=0)
                n[at] += np.diff(np.append(first, len(x)))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array((some // k).astype(np.int32)), pa.array((some % k).astype(np.int32)), pa.array(n[some]), lists(total[some])], names=["position", "entry", "n", "sums"])

    return run


def _reassigned(owners: Owners):
    """Members under the new books. One that keeps its entry keeps its owner; `moved` marks the others, with their new owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = owners.books.shape[2]
        for b in batches:
            position, old, salt, seed = (b.column(i).to_numpy() for i in range(4))
            x, entry = matrix(b.column(4), width).astype(np.int64), old.astype(np.int64)
            for p in np.unique(position):
                mine = position == p
                entry[mine] = nearest(x[mine], owners.books[p])[0]
            moved = entry != old
            salt = np.where(moved, owners.salt(position, entry, seed), salt)
            yield pa.RecordBatch.from_arrays([*_columns(position, entry, salt, seed), b.column(4), pa.array(moved)], names=["position", "entry", "salt", "seed", "part", "moved"])

    return run


def _coded(books: np.ndarray, scale: int):
    """Vectors as code and error; the other columns pass through."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(matrix(b.column(0), parts * width), scale)
            found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            code = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([row.tobytes().hex() for row in code], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def first_books(rows: DataFrame, dims: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest ids, ascending, a null id last. Of rows with one id the smallest vector counts."""
    order = F.col("vec_id").asc_nulls_last()
    ids = [r.vec_id for r in rows.select("vec_id").distinct().orderBy(order).limit(entries).collect()]
    known = [i for i in ids if i is not None]
    early = F.col("vec_id") <= F.lit(known[-1]) if known else F.lit(False)
    early = early | F.col("vec_id").isNull() if len(known) < len(ids) else early
    one = rows.where(early).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(order)
    x = whole(matrix(pa.array([r.vector for r in one.collect()], pa.list_(pa.float64())), dims), scale)
    return x.reshape(len(x), parts, dims // parts).transpose(1, 0, 2)


def lloyd(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> np.ndarray:
    """Codebooks (parts x entries x width, whole numbers) of rows (vec_id, vector of finite doubles), entries at most 256.

    State is a table of parts, dealt by (position, entry, salt) once. A round: the tasks that read an owner's members sum them where they
    are, one small row an entry and task; floor(sum / count) is the new entry (an entry without members stays); the members are assigned
    anew where they are, those that keep their entry stay in place and only the others are shuffled to their new owners. Books and
    counts, at most parts * entries rows whatever the input, are all that the driver sees. Each state is a written table, removed when the next one is there.
    """
    spark = rows.sparkSession
    width = -(-longest(rows, "vector") // parts)
    books = first_books(rows, parts * width, parts, entries, scale)
    k = books.shape[1]
    if not k or not width:
        return books
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner = ["position", "entry", "salt"]
    counts = np.zeros((parts, k), np.int64)
    for r in rows.select("vector").mapInArrow(_counted(books, scale), "position int, entry int, n long").groupBy("position", "entry").agg(F.sum("n").alias("n")).collect():
        counts[r.position, r.entry] = r.n
    placed = rows.select("vector").mapInArrow(_placed(Owners(books, counts, partitions), scale), PART)
    state, *folders = written(placed.repartition(*owner), "parts")
    for turn in range(rounds):
        partial = state.select("position", "entry", "part").mapInArrow(_sums((parts, k, width)), "position int, entry int, n long, sums array<long>")
        sums, n = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        by_place = partial.select("position", "entry", "n", F.posexplode("sums").alias("i", "s")).groupBy("position", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        for r in by_place.collect():
            sums[r.position, r.entry, r.i], n[r.position, r.entry] = r.s, r.n
        books = np.where(n[:, :, None] > 0, sums // np.maximum(n, 1)[:, :, None], books)
        if turn + 1 < rounds:
            anew = state.mapInArrow(_reassigned(Owners(books, n, partitions)), f"{PART}, moved boolean")
            anew, at = written(anew, "members", "moved")
            arrivals, came = written(anew.where("moved").drop("moved").repartition(*owner), "arrivals")
            state = anew.where("NOT moved").drop("moved").unionByName(arrivals)
            discard(spark, *folders)
            folders = [at, came]
    discard(spark, *folders)
    return books


def books_digest(books: np.ndarray) -> str:
    """sha-256 of the decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each row with a usable vector.

    Vectors that are null or hold null or non-finite components are dropped. Shorter vectors are filled up with zeros to the longest,
    and all to a multiple of `parts`. Components beyond 2^27 after scaling are taken as that. Fewer vectors than entries give smaller
    codebooks. Repeated rows each have their row and count in sums; of rows with one id the smallest vector can begin a codebook. Null
    ids and labels stay; null labels are one group. An empty table gives an empty one. Sums beyond a long are given as the largest long.
    """
    label_type = rows.schema[label_col].dataType
    usable = rows.where(finite(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    books = lloyd(usable.select("vec_id", "vector"), parts, entries, rounds, scale)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books.size:
        coded = usable.select("vec_id", "label", F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = usable.select("vector", "vec_id", "label").mapInArrow(_coded(books, scale), schema)
    coded = materialize(coded, "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    labels = materialize(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    right = labels.select(F.col("label").alias("_label"), "label_error")
    if labels.count() <= SMALL_SIDE:
        out = coded.join(F.broadcast(right), F.col("label").eqNullSafe(F.col("_label")), "left")
    else:
        out = join_spread(coded, labels.select("label", "label_error"), "label", labels.select("label", "n"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
