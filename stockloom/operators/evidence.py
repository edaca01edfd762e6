"""Weighing evidence: cell readings, several extractors' money, catalogue searches, and how sure a field is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.economics import econ_ok
from ..functions.keys import compact, norm
from ..functions.text import money, quantity

# Fixed values.
WEB_POINTS = {"model": 55, "brand_text": 18, "brand_host": 18, "category_each": 4, "category_most": 8, "marketplace": -20}
MARKETPLACES = r"(?:^|\.)(?:ebay|amazon|lazada|shopee|aliexpress|alibaba|carousell|qoo10)\."
LEAST_DPI = 300


def resolve_cells(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Quantity, price and amount of a row from readings of its cells.

    readings: keys, field, text, evidence_group, render_dpi, scope. Readings below 300 dpi or not of a cell are
    passed over. Readings of one group share pixels and are one voter. A row is resolved if exactly one triple of
    values multiplies out with the most votes; otherwise all three stay null, and both cases say so."""
    good = readings.where((F.col("scope") == "cell") & (F.col("render_dpi") >= LEAST_DPI))
    value = F.when(F.col("field") == "quantity", quantity("text")).otherwise(money("text"))
    votes = good.withColumn("v", value).where("v IS NOT NULL").groupBy(*keys, "field", "v").agg(F.count_distinct("evidence_group").alias("n"))
    part = lambda f, n: votes.where(F.col("field") == f).select(*keys, F.col("v").alias(f), F.col("n").alias(n))
    triples = part("quantity", "n1").join(part("unit_price", "n2"), keys).join(part("amount", "n3"), keys)
    triples = triples.where(econ_ok(F.col("quantity"), F.col("unit_price"), F.col("amount"), "strict")).withColumn("votes", F.col("n1") + F.col("n2") + F.col("n3"))
    w = Window.partitionBy(*keys)
    top = triples.withColumn("most", F.max("votes").over(w)).where("votes = most")
    one = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("quantity", "unit_price", "amount")).alias("t"))
    out = readings.select(*keys).distinct().join(one, keys, "left")
    unique = F.col("n") == 1
    return out.select(
        *keys, *[F.when(unique, F.col(f"t.{c}")).alias(c) for c in ("quantity", "unit_price", "amount")],
        F.when(unique, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unsupported").alias("status"),
    )


def money_consensus(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The economics that most distinct sources give, rows from a strict layout first among equals. Two strict ones with as many
    sources are a conflict; a lone source without strict layout is too weak. candidates: keys, source, strict, quantity, unit_price, amount."""
    q, p, a = F.col("quantity"), F.col("unit_price"), F.col("amount")
    sig = F.concat_ws("|", *[c.cast("decimal(18,2)").cast("string") for c in (q, p, a)])
    ok = candidates.where(econ_ok(q, p, a, "consensus")).withColumn("sig", sig)
    g = ok.groupBy(*keys, "sig").agg(F.count_distinct("source").alias("sources"), F.bool_or("strict").alias("strict"), F.min(F.struct("quantity", "unit_price", "amount")).alias("t"))
    w = Window.partitionBy(*keys).orderBy(F.desc("sources"), F.desc("strict"), "sig")
    g = g.withColumns({"place": F.row_number().over(w), "s2": F.lead("sources").over(w), "strict2": F.lead("strict").over(w)}).where("place = 1")
    conflict = F.coalesce(F.col("strict") & F.col("strict2") & (F.col("s2") >= F.col("sources")), F.lit(False))
    status = F.when(conflict, "conflict").when((F.col("sources") >= 2) | F.col("strict"), "resolved").otherwise("weak")
    return g.select(*keys, *[F.when(status == "resolved", F.col(f"t.{c}")).alias(c) for c in ("quantity", "unit_price", "amount")], "sources", status.alias("status"))


def rank_model_votes(votes: DataFrame, keys: list[str]) -> DataFrame:
    """The model code with the most explicit sources, then reliability, then all sources; a tie leaves it blank.
    votes: keys, model, source, explicit, reliability."""
    g = votes.groupBy(*keys, "model").agg(F.count_distinct(F.when(F.col("explicit"), F.col("source"))).alias("a"), F.max("reliability").alias("b"), F.count_distinct("source").alias("c"))
    rank = F.struct("a", "b", "c")
    top = g.groupBy(*keys).agg(F.max(rank).alias("best"))
    at = g.join(top, keys).where(rank == F.col("best")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("model").alias("m"))
    return at.select(*keys, F.when(F.col("n") == 1, F.col("m")).alias("model"), F.when(F.col("n") == 1, "resolved").otherwise("tie").alias("status"))


def shortest_popular(votes: DataFrame, keys: list[str], text: str, source: str) -> DataFrame:
    """Per key the text whose bare form most sources have, in its shortest spelling."""
    v = votes.withColumn("k", compact(text)).where("k <> ''")
    n = v.groupBy(*keys, "k").agg(F.count_distinct(source).alias("n"), F.min(F.struct(F.length(text).alias("l"), F.col(text).alias("t"))).alias("s"))
    return n.groupBy(*keys).agg(F.max_by(F.struct("s.t", "n"), F.struct("n", -F.col("s.l"), "s.t")).alias("b")).select(*keys, F.col("b.t").alias(text), F.col("b.n").alias("votes"))


def web_scores(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Points of every search result for its candidate. results: candidate_id, title, snippet, url; candidates: candidate_id, brand, model, words array."""
    r = results.join(candidates, "candidate_id")
    said, host = norm(F.concat_ws(" ", "title", "snippet")), F.lower(F.regexp_extract("url", r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1))
    m, b = compact("model"), norm("brand")
    bare = F.replace(b, F.lit(" "), F.lit(""))
    exact = (m != "") & F.contains(compact(F.concat_ws(" ", "title", "snippet")), m)
    in_text = (b != "") & F.contains(said, b)
    in_host = (F.length(bare) >= 4) & F.contains(F.regexp_replace(host, "[^a-z0-9]", ""), bare)
    hits = F.size(F.filter(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.contains(said, w)))
    market = host.rlike(MARKETPLACES)
    pts = lambda c, k: F.when(c, WEB_POINTS[k]).otherwise(0)
    score = pts(exact, "model") + pts(in_text, "brand_text") + pts(in_host, "brand_host") + F.least(F.lit(WEB_POINTS["category_most"]), hits * WEB_POINTS["category_each"]) + pts(market, "marketplace")
    return r.select("candidate_id", "url", host.alias("host"), score.alias("score"), exact.alias("exact"), (exact & ~market & (in_text | in_host)).alias("trusted"), (exact & ~market & in_host).alias("brand_domain"))


def web_verdicts(scored: DataFrame) -> DataFrame:
    """Confirmed by the brand's own domain or by two others that are no marketplaces."""
    g = scored.groupBy("candidate_id").agg(F.bool_or("brand_domain").alias("own"), F.count_distinct(F.when(F.col("trusted"), F.col("host"))).alias("domains"), F.max("score").alias("best"))
    yes = F.col("own") | (F.col("domains") >= 2)
    sure = F.least(F.lit(0.99), F.lit(0.72) + F.when(F.col("own"), 0.12).otherwise(0.0) + F.least(F.lit(0.15), F.col("domains") * 0.06))
    return g.select("candidate_id", F.when(yes, "confirmed").otherwise("unconfirmed").alias("status"), F.round(F.when(yes, sure).otherwise(F.least(F.lit(0.69), F.greatest(F.lit(0.0), F.col("best") / 100))), 2).alias("confidence"), "domains")


def document_money(subtotal: Column, tax: Column, total: Column) -> Column:
    """Subtotal, tax and total with the one missing filled in, and whether they add up; a negative tax is never made."""
    t = F.when(tax.isNull() & (total >= subtotal), F.round(total - subtotal, 2)).otherwise(tax)
    s = F.when(subtotal.isNull() & (total >= tax), F.round(total - tax, 2)).otherwise(subtotal)
    g = F.when(total.isNull(), F.round(subtotal + tax, 2)).otherwise(total)
    ok = F.abs(s + t - g) <= F.greatest(F.lit(0.05), F.abs(g) * 0.0001)
    return F.struct(s.alias("subtotal"), t.alias("tax"), g.alias("total"), F.coalesce(ok, F.lit(False)).alias("adds_up"))


def coverage(values: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Largest share of a value's words that one line of its document holds. Lines meet values by shared words,
    never all with all. values: key, field, value."""
    w = lambda c: F.explode(F.array_distinct(F.filter(F.split(norm(c), " "), lambda t: F.length(t) > 2)))
    v = values.select(key, "field", "value", w("value").alias("w"))
    size = v.groupBy(key, "field", "value").agg(F.count(F.lit(1)).alias("size"))
    hit = v.join(lines.select(key, "page", "line_no", w("line").alias("w")), [key, "w"]).groupBy(key, "field", "value", "page", "line_no").agg(F.count(F.lit(1)).alias("n"))
    best = hit.groupBy(key, "field", "value").agg(F.max("n").alias("n"))
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("size")
    return values.join(size, [key, "field", "value"], "left").join(best, [key, "field", "value"], "left").select(key, "field", "value", F.coalesce(share, F.lit(0.0)).alias("coverage"), (F.coalesce(share, F.lit(0.0)) >= 0.67).alias("supported"))


def recall_metrics(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: expected, found, both, and the share found."""
    both = expected.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_semi")
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    out = n(expected.select(*keys).distinct(), "expected").join(F.broadcast(n(found.select(*keys).distinct(), "found"))).join(F.broadcast(n(both, "both")))
    return out.withColumn("recall", F.try_divide("both", "expected"))


def contained_texts(docs: DataFrame, needles: DataFrame, few: int = 100_000) -> DataFrame:
    """Pairs (item_id, doc_id) where the whole text of the item stands in the text of the document, as contains() has it.

    docs: doc_id, text. needles: item_id, text. The words of a needle but its first and last stand whole in every text that
    holds it, so up to five of them in a row are its key and an equi-join with the runs of words of all documents finds every
    candidate; contains() decides. Needles of one or two words have no key and are sought in all texts, up to `few` by broadcast."""
    inner = F.expr("slice(w, 2, greatest(size(w) - 2, 0))")
    b = needles.where("text IS NOT NULL").select("item_id", F.col("text").alias("needle")).distinct().withColumn("w", F.split("needle", r"\s+"))
    b = b.withColumn("n", F.least(F.size(inner), F.lit(5))).withColumn("key", F.xxhash64("n", F.array_join(F.slice(inner, 1, 5), " ")))
    sizes = {r["n"]: r["count"] for r in b.groupBy("n").count().collect()}  # six rows at most
    hint = F.broadcast if sum(sizes.values()) <= few else lambda x: x
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    found = []
    lengths = sorted(n for n in sizes if n > 0)
    if lengths:
        runs = lambda n: F.expr(f"transform(sequence(1, size(w) - {n - 1}), i -> xxhash64({n}, array_join(slice(w, i, {n}), ' ')))")
        none = F.expr("array()").cast("array<bigint>")
        each = F.array_distinct(F.concat(*[F.when(F.size("w") >= n, runs(n)).otherwise(none) for n in lengths]))
        keys = texts.withColumn("w", F.split("text", r"\s+")).select("doc_id", F.explode(each).alias("key"))
        hits = keys.join(hint(b.where("n > 0").select("key", "item_id", "needle")), "key").select(F.col("doc_id").alias("_d"), "item_id", "needle").distinct()
        found.append(texts.join(hits, F.col("doc_id").eqNullSafe(F.col("_d"))).where(F.contains("text", "needle")).select("item_id", "doc_id"))
    if 0 in sizes:
        found.append(texts.join(hint(b.where("n = 0").select("item_id", "needle")), F.contains("text", "needle")).select("item_id", "doc_id"))
    if not found:
        return texts.crossJoin(b.select("item_id")).select("item_id", "doc_id").limit(0)
    return reduce(DataFrame.unionByName, found).distinct()
