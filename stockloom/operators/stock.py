"""Stock: summaries, listings, search and stock take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm


def inventory_summary(items: DataFrame, purchases: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Per item what was bought, what was taken away and what is left, which may be below zero. Two aggregates
    before the joins: neither side's rows multiply the other's."""
    bought = purchases.groupBy("item_id").agg(F.sum("quantity").alias("purchased"))
    gone = adjustments.groupBy("item_id").agg(F.sum("quantity").alias("adjusted"))
    zero = F.lit(0).cast("decimal(24,2)")
    out = items.join(bought, items["id"] == bought["item_id"], "left").drop("item_id").join(gone, items["id"] == gone["item_id"], "left").drop("item_id")
    out = out.withColumns({c: F.coalesce(c, zero).cast("decimal(24,2)") for c in ("purchased", "adjusted")})
    return out.withColumn("current", (F.col("purchased") - F.col("adjusted")).cast("decimal(25,2)"))


def dashboard_totals(summary: DataFrame, n_documents: DataFrame) -> DataFrame:
    """One row: items, units bought, units left, documents."""
    left = summary.agg(F.count(F.lit(1)).alias("n_items"), F.sum("purchased").alias("purchased"), F.sum("current").alias("current"))
    return left.join(F.broadcast(n_documents.agg(F.count(F.lit(1)).alias("n_documents"))))  # one row each


def item_partners(lines: DataFrame, partners: DataFrame, key: str, name: str) -> DataFrame:
    """item_id, partners: the distinct names behind the lines of an item, sorted."""
    pairs = lines.select("item_id", key).distinct().join(partners.select(key, name), key)
    return pairs.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set(name)), "|").alias("partners"), F.count_distinct(name).alias("n_partners"))


def search(items: DataFrame, partners: DataFrame, query: str, category: str | None = None) -> DataFrame:
    """Items whose normalised name, sku, category or partner names contain the normalised query."""
    hay = norm(F.concat_ws(" ", "item_name", "sku", "category", "partners"))
    wanted = norm(F.lit(query))
    out = items.join(partners, items["id"] == partners["item_id"], "left").where(hay.contains(wanted))
    return out.where(F.col("category") == category) if category else out


def grouped_by_first_partner(summary: DataFrame, partners: DataFrame) -> DataFrame:
    """Per first partner (Unknown if none): items and units left, A to Z without regard to case."""
    first = F.coalesce(F.element_at(F.split("partners", r"\|"), 1), F.lit("Unknown"))
    out = summary.join(partners, summary["id"] == partners["item_id"], "left").groupBy(first.alias("company"))
    return out.agg(F.count(F.lit(1)).alias("n_items"), F.sum("current").alias("current")).orderBy(F.lower("company"), "company")


def stock_take(summary: DataFrame, counted: DataFrame) -> DataFrame:
    """Counted less booked: Match, Short, Over, or Not counted. counted: item_id, physical."""
    out = summary.join(counted, summary["id"] == counted["item_id"], "left")
    diff = F.col("physical") - F.col("current")
    status = F.when(F.col("physical").isNull(), "Not counted").when(diff == 0, "Match").when(diff < 0, "Short").otherwise("Over")
    return out.select("id", "current", "physical", diff.alias("difference"), status.alias("status"))


def adjustment_allowed(summary: DataFrame, wanted: DataFrame) -> DataFrame:
    """An adjustment may not take more than there is. wanted: item_id, quantity."""
    out = wanted.join(summary.select(F.col("id").alias("item_id"), "current"), "item_id", "left")
    return out.withColumn("allowed", (F.col("quantity") > 0) & (F.col("quantity") <= F.coalesce("current", F.lit(0))))


def latest_per_group(rows: DataFrame, group: str, *newest_first: str) -> DataFrame:
    """The newest row of each group; later columns break ties, so the choice never depends on partitions."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*newest_first))
    return rows.groupBy(group).agg(best.alias("r")).select("r.*")


def merge_impact(pairs: DataFrame, lines: DataFrame, adjustments: DataFrame, serials: DataFrame) -> DataFrame:
    """What merging each pair of items would do, in both directions: from_id, to_id, lines_moved, adjustments_moved, serials_moved, stock_from, stock_to,
    stock_after, shared_serials, blockers. A pair is blocked by a serial that both items have, without regard to case, and by stock below zero afterwards.

    All references are summed once by item and met by two joins, so a pair costs no scan of its own. pairs: a, b; lines and
    adjustments: item_id, quantity (adjustments go off); serials: item_id, serial."""
    counted = lambda df, n, q: df.groupBy("item_id").agg(F.count(F.lit(1)).alias(n), F.sum("quantity").alias(q))
    s = serials.select("item_id", F.upper(F.trim("serial")).alias("serial")).where("serial <> ''")
    zero = F.lit(0)
    both = pairs.where("a <> b").select(F.col("a").alias("from_id"), F.col("b").alias("to_id"))
    both = both.unionByName(both.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))).distinct()
    ends = both.select(F.col("from_id").alias("item_id")).distinct()
    facts = ends.join(counted(lines, "lines", "bought"), "item_id", "left").join(counted(adjustments, "adjustments", "off"), "item_id", "left").join(s.groupBy("item_id").agg(F.count(F.lit(1)).alias("serials")), "item_id", "left")
    facts = facts.select("item_id", *[F.coalesce(c, zero).alias(c) for c in ("lines", "adjustments", "serials")], (F.coalesce("bought", zero) - F.coalesce("off", zero)).alias("stock"))
    known = s.distinct()
    shared = both.join(known.withColumnRenamed("item_id", "from_id"), "from_id").join(known.withColumnRenamed("item_id", "to_id"), ["to_id", "serial"]).groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("shared_serials"))
    out = both.join(facts.withColumnRenamed("item_id", "from_id").withColumnRenamed("stock", "stock_from"), "from_id").join(facts.select(F.col("item_id").alias("to_id"), F.col("stock").alias("stock_to")), "to_id").join(shared, ["from_id", "to_id"], "left")
    out = out.withColumns({"shared_serials": F.coalesce("shared_serials", zero), "stock_after": F.col("stock_from") + F.col("stock_to")})
    blockers = F.array_compact(F.array(F.when(F.col("shared_serials") > 0, "shared-serials"), F.when(F.col("stock_after") < 0, "negative-stock")))
    return out.select("from_id", "to_id", F.col("lines").alias("lines_moved"), F.col("adjustments").alias("adjustments_moved"), F.col("serials").alias("serials_moved"), "stock_from", "stock_to", "stock_after", "shared_serials", blockers.alias("blockers"))
