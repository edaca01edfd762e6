"""Audit events: what belongs to one action, what changed, and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hide_near(events: DataFrame, lead_type: str, follow_type: str, seconds: int, actor: str = "user_id", at: str = "ts", kind: str = "event_type", key: str = "event_id") -> DataFrame:
    """Leading events with the number of following-type events of the same actor at most so many seconds away.

    Buckets of the window's width turn the range into an equi-join: an event can only be near those of its own and the two
    neighbouring buckets, so an actor's whole history never meets itself."""
    stamp = F.unix_micros(F.col(at).cast("timestamp"))
    width = seconds * 1_000_000
    lead = events.where(F.col(kind) == lead_type).select(F.col(key).alias("lead_id"), F.col(actor).alias("actor"), stamp.alias("t0"), F.explode(F.sequence(F.floor(stamp / width) - 1, F.floor(stamp / width) + 1)).alias("bucket"))
    follow = events.where(F.col(kind) == follow_type).select(F.col(key).alias("follow_id"), F.col(actor).alias("actor"), stamp.alias("t1"), F.floor(stamp / width).alias("bucket"))
    return lead.join(follow, ["actor", "bucket"]).where(F.abs(F.col("t0") - F.col("t1")) <= width).select("lead_id", "follow_id", "actor")


def consolidate(events: DataFrame, lead_type: str, follow_type: str, seconds: int, **names) -> DataFrame:
    """Events without those that follow a leading one closely; the leading ones count what they hide. An event near several
    leading ones is hidden by the newest."""
    key, at, kind = names.get("key", "event_id"), names.get("at", "ts"), names.get("kind", "event_type")
    near = hide_near(events, lead_type, follow_type, seconds, **names)
    newest = near.join(events.select(F.col(key).alias("lead_id"), F.col(at).alias("_t")), "lead_id")
    owner = newest.groupBy("follow_id").agg(F.max_by("lead_id", F.struct("_t", "lead_id")).alias("lead_id"))
    counts = owner.groupBy("lead_id").agg(F.count(F.lit(1)).alias("n_hidden"))
    out = events.join(owner.select(F.col("follow_id").alias(key)), key, "left_anti").join(counts.withColumnRenamed("lead_id", key), key, "left")
    return out.withColumn("n_hidden", F.when(F.col(kind) == lead_type, F.coalesce("n_hidden", F.lit(0))))


def change_summary(events: DataFrame, key: str, old: str, new: str, ignore: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """key, field, old_value, new_value for every field whose text differs between two flat JSON objects."""
    as_map = lambda c: F.coalesce(F.from_json(F.col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = events.select(key, as_map(old).alias("o"), as_map(new).alias("n"))
    fields = F.array_distinct(F.concat(F.map_keys("o"), F.map_keys("n")))
    rows = rows.select(key, "o", "n", F.explode(fields).alias("field")).where(~F.col("field").isin(*ignore))
    rows = rows.select(key, "field", F.try_element_at("o", F.col("field")).alias("old_value"), F.try_element_at("n", F.col("field")).alias("new_value"))
    return rows.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def snapshot_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """INSERT, UPDATE and DELETE events between two states of a table, with both rows as JSON."""
    b = before.select(key, F.to_json(F.struct(*before.columns)).alias("old_data"))
    a = after.select(key, F.to_json(F.struct(*after.columns)).alias("new_data"))
    both = a.join(b, key, "full").where(~F.col("old_data").eqNullSafe(F.col("new_data")))
    return both.select(key, F.when(F.col("old_data").isNull(), "INSERT").when(F.col("new_data").isNull(), "DELETE").otherwise("UPDATE").alias("action"), "old_data", "new_data")


def inbox(feedback: DataFrame, notices: DataFrame, status: str | None = None, newest: int = 100) -> DataFrame:
    """The newest entries of two tables, those of one status if asked for."""
    rows = feedback.select("id", "created_at", "status", F.lit("feedback").alias("kind")).unionByName(notices.select("id", "created_at", "status", F.lit("notice").alias("kind")))
    rows = rows.where(F.col("status") == status) if status else rows
    return rows.orderBy(F.desc_nulls_last("created_at"), "kind", "id").limit(newest)


def sessions(events: DataFrame, gap_seconds: int, actor: str = "user_id", at: str = "ts") -> DataFrame:
    """Runs of an actor's events whose gaps are at most so long."""
    w = Window.partitionBy(actor).orderBy(at)
    stamp = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.coalesce((stamp - F.lag(stamp).over(w)) > gap_seconds * 1_000_000, F.lit(True)).cast("int")
    e = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(actor, "session").agg(F.count(F.lit(1)).alias("n_events"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
