"""Data health: findings, their weights, score and history; integrity of references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import health_issue_key, present

# Severities and their weight in the score, and where each rule is counted.
WEIGHTS = {"high": 12, "medium": 7, "low": 3}
RULES = {
    "Missing category": "medium",
    "Serial review": "low",
    "Negative inventory": "high",
    "Missing invoice date": "high",
    "Unlinked document": "medium",
    "Possible duplicate": "medium",
    "Duplicate serial": "high",
}


def findings(rows: DataFrame, rule: str, entity: str, id_col: str = "id") -> DataFrame:
    """Rows that a rule has picked, as findings: issue_key, severity, issue_type, entity_type, entity_id."""
    return rows.select(
        health_issue_key(F.lit(rule), F.lit(entity), F.col(id_col)).alias("issue_key"),
        F.lit(RULES[rule]).alias("severity"),
        F.lit(rule).alias("issue_type"),
        F.lit(entity).alias("entity_type"),
        F.col(id_col).cast("string").alias("entity_id"),
    )


def all_findings(summary: DataFrame, serials: DataFrame, purchases: DataFrame, documents: DataFrame, lines: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Seven rules over items, purchases, documents and serials, in one union."""
    with_serial = serials.select(F.col("item_id").alias("id")).distinct()
    twice = serials.groupBy(F.lower(F.trim("serial")).alias("id")).count().where("count > 1")
    parts = [
        findings(summary.where(present("category").isNull()), "Missing category", "master_items"),
        findings(summary.where("purchased > 0").join(with_serial, "id", "left_anti"), "Serial review", "master_items"),
        findings(summary.where("current < 0"), "Negative inventory", "master_items"),
        findings(purchases.where("day IS NULL"), "Missing invoice date", "purchases"),
        findings(documents.join(lines.select(F.col("purchase_id").alias("id")), "id", "left_anti"), "Unlinked document", "documents"),
        findings(duplicates, "Possible duplicate", "master_items"),
        findings(twice, "Duplicate serial", "serial_numbers"),
    ]
    return reduce(DataFrame.unionByName, parts)


def open_findings(found: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings that are not resolved. A review only marks them. reviews: issue_key, resolution_status."""
    state = reviews.groupBy("issue_key").agg(F.bool_or(F.coalesce(F.col("resolution_status") == "resolved", F.lit(False))).alias("resolved"))
    out = found.join(state, "issue_key", "left")
    return out.where(~F.coalesce("resolved", F.lit(False))).withColumn("reviewed", F.col("resolved").isNotNull()).drop("resolved")


def score(found: DataFrame) -> DataFrame:
    """100 less the weights of the findings, at most 85 of them; with its label."""
    weight = reduce(lambda c, kv: c.when(F.col("severity") == kv[0], kv[1]), WEIGHTS.items(), F.when(F.lit(False), 0)).otherwise(5)
    out = found.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("w")).select((100 - F.least(F.lit(85), F.col("w"))).cast("long").alias("score"))
    return out.withColumn("label", label(F.col("score")))


def label(s: Column) -> Column:
    return F.when(s >= 95, "Excellent").when(s >= 85, "Good").when(s >= 70, "Fair").otherwise("Needs attention")


def breakdown(found: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("issue_type") == "Missing category", "missing_category")
        .when(F.col("issue_type").isin("Serial review", "Duplicate serial"), "serial")
        .when(F.col("issue_type").isin("Unlinked document", "Missing invoice date"), "document")
        .otherwise("other")
    )
    return found.groupBy(kind.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def history(reviews: DataFrame, found: DataFrame) -> DataFrame:
    """Reviews with what became of them: still-detected if the finding is there now, else resolved."""
    now = found.select("issue_key").distinct().withColumn("_now", F.lit(True))
    return reviews.join(now, "issue_key", "left").withColumn("status", F.when(F.col("_now"), "still-detected").otherwise("resolved")).drop("_now")


def orphans(children: DataFrame, key: str, parents: DataFrame, parent_key: str, name: str, nulls_count: bool = False) -> DataFrame:
    """One row: how many children point nowhere. A null reference counts only on request."""
    kids = children.select(F.col(key).alias("k"))
    lost = kids.where("k IS NOT NULL").join(parents.select(F.col(parent_key).alias("k")).distinct(), "k", "left_anti")
    if nulls_count:
        lost = lost.union(kids.where("k IS NULL"))
    return lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")


def integrity_status(counts: DataFrame) -> DataFrame:
    """The counts, and PASS or FAIL for each."""
    return counts.withColumn("status", F.when(F.col("n") == 0, "PASS").otherwise("FAIL"))


def byte_total(size: str = "size") -> Column:
    """Sum of sizes; a size that is no whole number counts as zero."""
    return F.sum(F.coalesce(F.expr(f"try_cast({size} AS BIGINT)"), F.lit(0)))


def verify_contents(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    """Per document what its stored bytes tell: no-path, missing, empty, no-hash, bad-hash or verified.
    documents: id, storage_path, file_sha256; blobs: name, size, sha256."""
    out = documents.join(blobs.select(F.col("name").alias("storage_path"), "size", "sha256"), "storage_path", "left")
    said = (
        F.when(present("storage_path").isNull(), "no-path")
        .when(F.col("sha256").isNull(), "missing")
        .when(F.coalesce(F.expr("try_cast(size AS BIGINT)"), F.lit(0)) <= 0, "empty")
        .when(present("file_sha256").isNull(), "no-hash")
        .when(F.lower("file_sha256") != F.col("sha256"), "bad-hash")
        .otherwise("verified")
    )
    return out.select("id", said.alias("outcome"))


def backup_status(age_hours: Column) -> Column:
    """Newest backup up to 36 hours old passes, up to 60 warns; none is unknown."""
    return F.when(age_hours.isNull(), "UNKNOWN").when(age_hours <= 36, "PASS").when(age_hours <= 60, "WARN").otherwise("FAIL")


def worst(status: str = "status") -> Column:
    """The worst of a group's states; unknown ranks as a warning."""
    rank = F.when(F.col(status) == "FAIL", 2).when(F.col(status).isin("WARN", "UNKNOWN"), 1).otherwise(0)
    return F.max_by(F.col(status), F.struct(rank, F.col(status)))
