"""Row accounting: which physical rows exist, which repeat, and what several extractors agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_occurrence(rows: DataFrame, key: str, origin: str, ordinal: str) -> DataFrame:
    """The k-th row of a key within an origin is physical row k of that key."""
    w = Window.partitionBy(origin, key).orderBy(ordinal)
    return rows.withColumn("occurrence", F.row_number().over(w))


def ledger(rows: DataFrame, key: str, origin: str, ordinal: str, strength: str) -> DataFrame:
    """One row per physical row: its origins, and the ordinal of its strongest reading."""
    r = with_occurrence(rows.where(F.col(key) != ""), key, origin, ordinal)
    return r.groupBy(key, "occurrence").agg(
        F.count_distinct(origin).alias("n_origins"), F.max_by(ordinal, F.struct(F.col(strength), -F.col(ordinal))).alias("best_ordinal"), F.max(strength).alias("strength")
    )


def missing_from(ledger_rows: DataFrame, final: DataFrame, key: str) -> DataFrame:
    """Physical rows that the final set lacks, repeats counted."""
    return ledger_rows.join(final.select(key, "occurrence"), [key, "occurrence"], "left_anti")


def dedupe_exact(rows: DataFrame, signature: str, *order: str) -> DataFrame:
    """The first row of each signature; rows with an empty one are all kept."""
    w = Window.partitionBy(signature).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | (F.col(signature) == "")).drop("_n")


def consolidate_sku(rows: DataFrame, sku: str, economics: str, rank: Column, *tie: str) -> DataFrame:
    """One row per sku survives: collapsed if all economics are alike, in conflict if not; the others name it."""
    w = Window.partitionBy(sku)
    ordered = w.orderBy(rank.desc(), *tie)
    out = rows.withColumns({
        "_place": F.row_number().over(ordered),
        "_n": F.count(F.lit(1)).over(w),
        "_alike": F.min(economics).over(w).eqNullSafe(F.max(economics).over(w)),
    })
    status = (
        F.when(F.col("_n") == 1, "single")
        .when(F.col("_alike"), F.when(F.col("_place") == 1, "collapsed").otherwise("duplicate-collapsed"))
        .otherwise(F.when(F.col("_place") == 1, "conflict").otherwise("conflict-member"))
    )
    return out.withColumn("status", status).drop("_place", "_n", "_alike")


def vote(readings: DataFrame, keys: list[str], value: str, source: str, least: int = 2) -> DataFrame:
    """The value that most distinct sources have read. Fewer than `least` votes or a tie at the top gives
    none: blank, to be reviewed, never a guess. Rows of one source are one voter."""
    votes = readings.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_distinct(source).alias("votes"))
    ranked = votes.groupBy(*keys).agg(
        F.max_by(value, F.struct("votes", value)).alias("top"), F.max("votes").alias("votes"), F.sum("votes").alias("all_votes"),
        F.sort_array(F.collect_list("votes"), asc=False).alias("_v"),
    )
    tie = F.coalesce(F.try_element_at("_v", F.lit(2)) == F.col("votes"), F.lit(False))
    status = F.when(tie, "tie").when(F.col("votes") < least, "weak").otherwise("resolved")
    return ranked.select(*keys, F.when(status == "resolved", F.col("top")).alias("value"), "votes", status.alias("status"))


def choose_header(candidates: DataFrame, keys: list[str], least: float = 90.0, close: float = 20.0) -> DataFrame:
    """Per field the value whose best score, support and sum stand out; blank if too weak or if another
    strong value is close. candidates: keys, value, score, source."""
    g = candidates.groupBy(*keys, "value").agg(F.max("score").alias("best"), F.sum(F.greatest(F.lit(0.0), F.col("score"))).alias("total"), F.count_distinct("source").alias("support"))
    g = g.withColumn("rank_score", F.col("best") + F.least(F.lit(30.0), F.col("total") / 10) + F.col("support") * 8)
    w = Window.partitionBy(*keys).orderBy(F.desc("rank_score"), "value")
    g = g.withColumns({"place": F.row_number().over(w), "second": F.lead("best").over(w)})
    conflict = F.coalesce((F.col("second") >= least) & (F.abs(F.col("best") - F.col("second")) < close), F.lit(False))
    status = F.when(F.col("best") < least, "insufficient-evidence").when(conflict, "conflicting-evidence").otherwise("resolved")
    return g.where("place = 1").select(*keys, F.when(status == "resolved", F.col("value")).alias("value"), "support", status.alias("status"))


def backfill(rows: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Per key the first known value of each column, from the best row on."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(key, *[F.first(c, ignorenulls=True).over(whole).alias(c) for c in columns], F.row_number().over(w).alias("_n")).where("_n = 1").drop("_n")


def fill_gaps(rows: DataFrame, group: str, position: str, ordinal: str) -> DataFrame:
    """Ordinals of unnumbered rows between two numbered ones, only if exactly as many are missing."""
    w = Window.partitionBy(group).orderBy(position)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    r = rows.withColumns({"_lo": F.last(ordinal, True).over(before), "_hi": F.first(ordinal, True).over(after)})
    r = r.withColumns({"_n": F.count(F.when(F.col(ordinal).isNull(), 1)).over(Window.partitionBy(group, "_lo", "_hi")), "_k": F.row_number().over(Window.partitionBy(group, "_lo", "_hi", F.col(ordinal).isNull()).orderBy(position))})
    fits = F.col(ordinal).isNull() & (F.col("_hi") - F.col("_lo") - 1 == F.col("_n"))
    return r.withColumn("filled", F.coalesce(ordinal, F.when(fits, F.col("_lo") + F.col("_k")))).drop("_lo", "_hi", "_n", "_k")
