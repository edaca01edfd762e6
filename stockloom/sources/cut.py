"""Cut points: tables written where every executor sees them, for plans that read one result many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a session on this machine alone gets one of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="stockloom-")


def cut(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """df, written once and read back, so that what follows does not compute it again and a lost executor costs none of it. With a key, rows
    lie together by it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back if key is None else spread(back, back, key)


def spread(df: DataFrame, table: DataFrame, key: str, each: int = 30_000) -> DataFrame:
    """df with the rows of a document in one task, and tasks of some 30 000 rows of the table that it comes from, whose number its files tell.

    Windows, groups and joins by the document and more then need no further shuffle, and what a row unfolds into is sorted in memory at any size of the table."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, table.count() // each + 1)
    return df.repartition(tasks, key)
