"""Ranking whole candidate sets of line items, and the verdict on the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.economics import complete, econ_ok, within
from ..functions.keys import clean, evidence_identity_key
from ..sources.cut import cut

# Points of a row and of a set.
ROW_POINTS = {"description": 18, "no_description": -50, "sku": 10, "econ_ok": 42, "econ_conflict": -70, "econ_incomplete": -18, "layout": 12, "economic": 12, "provenance": 8, "review": -45, "non_inventory": -100, "metadata": -120}
SET_POINTS = {"supported": 10, "agreed": 10, "subtotal_ok": 55, "subtotal_off": -25, "duplicate": -35, "unresolved": -8}
METADATA = r"^(?:serial(?:\s*(?:no|number|numbers))?|s/n|warranty|remark|remarks|note|notes)\b"
THRESHOLD = 0.72


def assess_rows(rows: DataFrame) -> DataFrame:
    """rows (doc_id, origin, ordinal, sku, item_name, quantity, unit_price, amount; optional flags) with identity, points and needs_review."""
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in rows.columns else F.lit(False)
    q, p, a = (F.col(c).cast("double") for c in ("quantity", "unit_price", "amount"))
    ok, full = econ_ok(q, p, a, "evidence"), complete(q, p, a)
    meta = F.lower(clean("item_name")).rlike(METADATA)
    pts = lambda cond, yes, no=0: F.when(cond, F.lit(ROW_POINTS[yes])).otherwise(F.lit(ROW_POINTS[no] if no else 0))
    econ = F.when(ok, ROW_POINTS["econ_ok"]).when(full, ROW_POINTS["econ_conflict"]).otherwise(ROW_POINTS["econ_incomplete"])
    points = (
        pts(clean("item_name") != "", "description", "no_description") + pts(clean("sku") != "", "sku") + econ + pts(flag("layout_verified"), "layout") + pts(flag("economic_verified"), "economic")
        + pts(flag("has_provenance"), "provenance") + pts(flag("review_flag"), "review") + pts(flag("non_inventory"), "non_inventory") + pts(meta, "metadata")
    )
    return rows.withColumns({
        "identity": evidence_identity_key("sku", "item_name"), "points": points, "econ_ok": ok, "econ_complete": full,
        "needs_review": flag("review_flag") | flag("non_inventory") | meta,
    })


def assess_sets(rows: DataFrame, subtotals: DataFrame | None = None) -> DataFrame:
    """Per document and origin the score of its set. Agreement looks at each other origin's first row of the same
    identity: one reading per origin, so a set cannot support itself. subtotals: doc_id, subtotal."""
    return _score_sets(_assessed(rows), subtotals)


def _assessed(rows: DataFrame) -> DataFrame:
    """Rows with their identity and points, written once: every branch of the sums reads these few columns."""
    keep = ("doc_id", "origin", "ordinal", "quantity", "unit_price", "amount", "identity", "points", "econ_ok", "econ_complete", "needs_review")
    return cut(assess_rows(rows).select(*keep), "assessed")


def _score_sets(r: DataFrame, subtotals: DataFrame | None) -> DataFrame:
    first = r.where("identity <> ''").groupBy("doc_id", "identity", "origin").agg(F.min(F.struct("ordinal", "quantity", "unit_price", "amount")).alias("h"))
    first = first.select("doc_id", "identity", F.col("origin").alias("other"), "h.quantity", "h.unit_price", "h.amount")
    mine = r.where("identity <> ''").select("doc_id", "identity", "origin", "ordinal", *[F.col(c).alias(f"m_{c}") for c in ("quantity", "unit_price", "amount")])
    pairs = mine.join(first, ["doc_id", "identity"]).where("origin <> other")

    def near(a: str, tolerance: float) -> Column:
        return F.coalesce(F.abs(F.col(f"m_{a}").cast("double") - F.col(a).cast("double")) <= tolerance, F.lit(True))

    agreed = near("quantity", 0.0) & near("unit_price", 0.01) & near("amount", 0.01)
    support = pairs.groupBy("doc_id", "origin", "ordinal").agg(F.bool_or(agreed).alias("agreed"))
    support = support.groupBy("doc_id", "origin").agg(F.count(F.lit(1)).alias("supported"), F.count_if("agreed").alias("agreed"))
    sets = r.groupBy("doc_id", "origin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("points").alias("row_points"), F.count_distinct(F.when(F.col("identity") != "", F.col("identity"))).alias("n_identities"),
        F.sum(F.coalesce(F.col("amount").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))).alias("amount_sum"), F.count("amount").alias("n_amounts"),
        F.count_if(F.col("needs_review") | ~F.col("econ_ok")).alias("unresolved"),
    )
    sets = sets.join(support, ["doc_id", "origin"], "left")
    sets = sets.join(subtotals, "doc_id", "left") if subtotals is not None else sets.withColumn("subtotal", F.lit(None).cast("double"))
    s = F.col("subtotal").cast("double")
    sub = F.when(s.isNull() | (s < 0) | (F.col("n_amounts") == 0), 0).when(within(F.col("amount_sum").cast("double"), s, "subtotal_score"), SET_POINTS["subtotal_ok"]).otherwise(SET_POINTS["subtotal_off"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = (
        F.col("row_points") + zero("supported") * SET_POINTS["supported"] + zero("agreed") * SET_POINTS["agreed"] + sub
        + F.greatest(F.lit(0), F.col("n_rows") - F.col("n_identities")) * SET_POINTS["duplicate"] + F.col("unresolved") * SET_POINTS["unresolved"]
    )
    return sets.select("doc_id", "origin", "n_rows", "amount_sum", "subtotal", "unresolved", total.cast("long").alias("score"))


def rank_sets(sets: DataFrame) -> DataFrame:
    """Best set of each document, its margin over the next and a confidence from 0 to 1."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "origin")
    best = sets.withColumns({"_n": F.row_number().over(w), "_next": F.lead("score").over(w)}).where("_n = 1")
    margin = F.col("score") - F.coalesce("_next", "score")
    high = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") + 80) / 260))
    sure = F.greatest(F.lit(0.45), F.least(F.lit(1.0), F.lit(0.55) + F.greatest(F.lit(0), margin) / 180))
    return best.withColumns({"margin": margin, "confidence": F.floor(high * sure * 1000 + F.lit(0.5)) / 1000}).drop("_n", "_next")


def verdicts(rows: DataFrame, subtotals: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document the winner, and accepted or review with the reasons. Accepted means that every row's arithmetic holds."""
    assessed = _assessed(rows)
    best = rank_sets(_score_sets(assessed, subtotals))
    r = assessed.join(best.select("doc_id", "origin"), ["doc_id", "origin"])
    why = F.when(F.col("econ_complete") & ~F.col("econ_ok"), "economic-mismatch").when(F.col("needs_review"), "structural-review").when(~F.col("econ_complete"), "incomplete-economics")
    judged = r.groupBy("doc_id").agg(F.sort_array(F.collect_set(why)).alias("row_reasons"), F.sum(F.when(why.isNull(), F.col("amount").cast("decimal(18,2)"))).alias("accepted_sum"))
    out = best.join(judged, "doc_id")
    s = F.col("subtotal").cast("double")
    off = F.coalesce(~within(F.coalesce(F.col("accepted_sum").cast("double"), F.lit(0.0)), s, "subtotal_accept"), F.lit(False))
    reasons = F.array_compact(F.concat("row_reasons", F.array(F.when(off, "subtotal-mismatch"), F.when(F.col("confidence") < threshold, "low-confidence"))))
    return out.select("doc_id", F.col("origin").alias("winner"), "score", "margin", "confidence", F.when(F.size(reasons) == 0, "accepted").otherwise("review").alias("status"), F.array_join(reasons, ",").alias("reasons"))
