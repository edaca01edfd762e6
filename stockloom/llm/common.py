"""Helpers shared by the training-data operators: inputs, folds, cut points, tiles.

Every operator selects the columns it needs by name, so extra columns of the caller never clash.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the decimal text of the id; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a session on this machine alone (tests) gets one of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stockloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends at files that
    every executor sees, and what reads them has their true size in its statistics."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """As materialize, and the folder, for discard(); `by` names columns, the last ones, to cut the folder by."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_spread(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None, share: int = 20_000, least: int = 1000) -> DataFrame:
    """left with the columns of right, which has at most one row a key; null keys meet null keys, and left rows without partner stay.

    A key with more than 1/share of left's rows (and more than `least`) is hot. Whatever the size there are fewer than `share` of these, so
    their list is broadcast; their rows are dealt over parts of that many rows, and right's row is copied to each part, fewer than
    2 * share copies in all. counts: (key, n) of left, if known.
    """
    counts = counts if counts is not None else materialize(left.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(least, -(-total // share))
    hot = F.broadcast(counts.where(F.col("n") > limit).select(F.col(key).alias("_hot"), F.ceil(F.col("n") / limit).cast("int").alias("_parts")))
    meets = F.col(key).eqNullSafe(F.col("_hot"))
    dealt = left.join(hot, meets, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_hot", "_parts")
    copies = right.join(hot, meets, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts").withColumnRenamed(key, "_key")
    return dealt.join(copies, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_copy")), "left").drop("_key", "_part", "_copy")


def broadcast_if_under(df: DataFrame, rows: int) -> DataFrame:
    """df, materialised; marked for broadcast only if it is counted to hold at most so many rows.
    Beyond that the planner joins it as any other table."""
    kept = materialize(df, "side")
    return F.broadcast(kept) if kept.count() <= rows else kept


#: A side of up to so many rows of a few longs (some MB) may be sent to every executor.
SMALL_SIDE = 200_000


def deal_tiles(df: DataFrame, key: str, member: str, tile: int) -> DataFrame:
    """Rows of df, each once for every cell it takes part in: columns cell_a, cell_b, part are added.

    A key with at most `tile` rows is one cell (0, 0). A larger one is cut into g parts by a hash of
    `member`; cells are the pairs of parts, so no cell holds more than about two tiles and all pairs of the key's
    rows meet in exactly one cell: those of one part in (i, i), others in (i, j), i < j.
    """
    big = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile)
    big = broadcast_if_under(big.select(key, F.ceil(F.col("_n") / tile).cast("int").alias("_g")), SMALL_SIDE)
    g = F.coalesce("_g", F.lit(1))
    return (
        df.join(big, key, "left")
        .withColumn("part", F.pmod(F.xxhash64(member, F.lit(11)), g).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), g - 1)))
        .withColumn("cell_a", F.least("part", "_other").cast("int"))
        .withColumn("cell_b", F.greatest("part", "_other").cast("int"))
        .drop("_g", "_other")
    )


def whole_groups(batches, columns: list[str]):
    """Record batches whose rows are sorted by `columns`, cut anew so that no group is split.

    Holds the rows of one group and one batch at a time."""
    held: list[pa.RecordBatch] = []
    last = None

    def keys(b):
        return [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]

    for b in batches:
        if not b.num_rows:
            continue
        k = keys(b)
        change = np.zeros(b.num_rows, bool)
        for c in k:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(x != c[0] for x, c in zip(last, k, strict=True))
        cuts = np.flatnonzero(change)
        last = [c[-1] for c in k]
        if len(cuts):
            cut = int(cuts[-1])
            yield pa.Table.from_batches([*held, b.slice(0, cut)]) if cut or held else None
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(arrays: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(arrays[0])
    change = np.zeros(n, bool)
    change[0] = True
    for a in arrays:
        change[1:] |= a[1:] != a[:-1]
    return np.append(np.flatnonzero(change), n)


def local_labels(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each index of a symmetric link matrix can reach."""
    n = len(linked)
    label = np.arange(n, dtype=np.int32)
    while True:
        new = label.copy()
        for s in range(0, n, 256):  # a few MB at a time
            part = linked[s : s + 256]
            new[s : s + 256] = np.minimum(new[s : s + 256], np.where(part, label[None, :], np.int32(n)).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label.astype(np.int64)
        label = new
