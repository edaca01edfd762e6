"""Verification levels, review and save checks, supplier corrections and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.economics import complete, econ_ok
from ..functions.keys import clean, supplier_key


def level_one(row_class: Column, has_proof: Column, q: Column, p: Column, a: Column) -> Column:
    """reject what is no equipment, verify what is printed and adds up, review what contradicts itself; else candidate."""
    ok = econ_ok(q, p, a, "gate")
    return (
        F.when(row_class.isin("service", "accessory", "warranty", "noninventory"), "reject")
        .when(complete(q, p, a) & ~ok, "review")
        .when(has_proof & ok, "verified")
        .otherwise("candidate")
    )


def save_violations(lines: DataFrame, serials: DataFrame | None = None) -> DataFrame:
    """Every reason against saving, one row each: a document is saved only if it has none, all of its lines or nothing.
    lines: doc_id, line_no, item_name, quantity, unit_price, amount; serials: doc_id, line_no, serial."""
    q, p, a = F.col("quantity"), F.col("unit_price"), F.col("amount")
    checks = F.array(
        F.when(F.coalesce(q <= 0, F.lit(True)), "quantity"),
        F.when(clean("item_name") == "", "item-name"),
        F.when(p.isNull() | a.isNull(), "economics-missing"),
        F.when(complete(q, p, a) & ~econ_ok(q.cast("double"), p.cast("double"), a.cast("double"), "save"), "economics-mismatch"),
    )
    out = lines.select("doc_id", "line_no", F.explode(F.array_compact(checks)).alias("violation"))
    if serials is not None:
        s = serials.select("doc_id", "line_no", F.lower(F.trim("serial")).alias("s"))
        twice = s.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(s.join(twice, "s").select("doc_id", "line_no", F.lit("duplicate-serial").alias("violation")).distinct())
    return out


def publishable(lines: DataFrame, violations: DataFrame) -> DataFrame:
    """Lines of documents without a violation."""
    return lines.join(violations.select("doc_id").distinct(), "doc_id", "left_anti")


def new_corrections(batch: DataFrame, known: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Corrections worth recording: of a known field, that change something and are not recorded yet. The batch is
    made distinct first, since a later entry would have met the earlier. Columns: supplier, field_name, source_value, corrected_value."""
    key = ["supplier_key", "field_name", "source_value", "corrected_value"]
    fresh = batch.where(F.col("field_name").isin(*fields) & ~F.col("source_value").eqNullSafe(F.col("corrected_value")))
    fresh = fresh.select(supplier_key("supplier").alias("supplier_key"), "field_name", "source_value", "corrected_value").distinct()
    return fresh.join(known.where(F.col("status").isin("pending", "approved")).select(*key), key, "left_anti")


def upsert_profiles(profiles: DataFrame, seen: DataFrame) -> DataFrame:
    """Supplier profiles after observations: labels merged, the newer value wins; counts and dates grow.
    profiles: supplier_key, labels map, sample_count, first_seen, last_seen; seen: supplier_key, labels map, seen_at."""
    new = seen.groupBy("supplier_key").agg(
        F.max_by("labels", "seen_at").alias("_labels"), F.count(F.lit(1)).alias("_n"), F.min("seen_at").alias("_first"), F.max("seen_at").alias("_last")
    )
    out = profiles.join(new, "supplier_key", "full")
    none = F.create_map().cast("map<string,string>")
    old, add = F.coalesce("labels", none), F.coalesce("_labels", none)
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(add), k)), add)
    return out.select(
        "supplier_key", merged.alias("labels"), (F.coalesce("sample_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("sample_count"),
        F.least("first_seen", "_first").alias("first_seen"), F.greatest("last_seen", "_last").alias("last_seen"),
    )
