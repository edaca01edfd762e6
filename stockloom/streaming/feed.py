"""The audit feed as a stream: incremental answers that equal the batch ones on replay."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_feed(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    """Audit files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def distinct_events(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once, though sources deliver at least once; keys are forgotten once the watermark has passed."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def feed_sessions(events: DataFrame, gap: str = "8 seconds", actor: str = "user_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Runs of an actor's events with gaps up to `gap`: the stream's form of the proximity rule."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap), actor)
    return grouped.agg(F.count(F.lit(1)).alias("n_events")).select(actor, F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("closes_at"), "n_events")


def unread_counts(events: DataFrame, status: str = "status", kind: str = "kind") -> DataFrame:
    """Unread entries by kind; for complete output mode."""
    return events.groupBy(kind).agg(F.count_if(F.col(status) == "unread").alias("unread"))


def refresh(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Calls write(batch, id) for every micro-batch; without `every` it drains what is there and stops. A restart resumes at the checkpoint."""
    q = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(processingTime=every) if every else q.trigger(availableNow=True)).start()


def drain(events: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what has arrived and returns what it wrote, as a table in the folder of spark.checkpoint.dir, which all executors
    share; where that is unset, a session on this machine alone (tests) uses one of its own, and a cluster is an error."""
    spark = events.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="feed-")
    base = f"{root}/{name}-{uuid.uuid4().hex}"
    out = events.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{base}/rows")
