"""Saving documents all or nothing: staged tables that one manifest row makes visible."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch string, at timestamp"
DOCUMENTS = "doc_id long, digest string, batch string"


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def current(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, digest, batch: every saved document with the last batch that holds it."""
    batches = _stored(spark, f"{root}/manifest", MANIFEST)
    docs = _stored(spark, f"{root}/documents", DOCUMENTS).join(batches, "batch")
    return docs.groupBy("doc_id").agg(F.max_by(F.struct("digest", "batch"), F.struct("at", "batch")).alias("x")).select("doc_id", "x.*")


def saved(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of a table as last saved. A batch without a manifest row, of a job that failed or still runs, is not there."""
    rows = _stored(spark, f"{root}/{name}", f"{schema}, batch string")
    return rows.join(current(spark, root).select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").drop("batch")


def publish(root: str, tables: dict[str, DataFrame]) -> str | None:
    """Saves documents with all their rows in all tables, or none of them; the batch's name, None if nothing was new.

    tables: DataFrames with doc_id. Each table is written to a folder of its own batch, which no reader looks at; when all stand, one row in one file of the
    manifest makes them visible at once. Any row that fails, and any task that is lost for good, leaves what was saved before as it was; staged
    folders without a row are left over and never read. A document whose rows are what is saved already is not written again, so saving
    twice is saving once; one with other rows takes the place of its former ones. Documents of one batch meet in sums of row digests, not in lists."""
    spark = next(iter(tables.values())).sparkSession
    parts = None
    for name, df in sorted(tables.items()):
        row = F.xxhash64(F.lit(name), *[F.col(c) for c in sorted(df.columns)])
        again = F.xxhash64(F.lit(7), F.lit(name), *[F.col(c) for c in sorted(df.columns)])
        one = df.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("h"), again.alias("g"))
        parts = one if parts is None else parts.unionByName(one)
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string")
    digests = parts.groupBy("doc_id").agg(F.concat_ws("|", F.count(F.lit(1)).cast("string"), whole("h"), whole("g")).alias("digest"))
    stored = current(spark, root).select("doc_id", "digest")
    batch = uuid.uuid4().hex
    at = lambda name: f"{root}/{name}/batch={batch}"
    digests.join(stored, ["doc_id", "digest"], "left_anti").select("doc_id", "digest").write.parquet(at("documents"))
    new = spark.read.schema("doc_id long, digest string").parquet(at("documents"))
    if new.isEmpty():
        return None
    for name, df in tables.items():
        df.join(new.select("doc_id"), "doc_id", "left_semi").write.parquet(at(name))
    spark.range(1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return batch
