"""One-to-one matches inside a document: pairs are scored in joins, and only the choice among them is sequential."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _points(a: str, b: str) -> Column:
    """How well two rows agree: 3 for shared words, 6 for an equal sku, and economics that agree or differ."""
    x, y = F.col(f"{a}.words"), F.col(f"{b}.words")
    out = F.when((F.size(x) > 0) & (F.size(y) > 0), F.lit(3.0) * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(F.lit(0.0))
    out = out + F.when((F.col(f"{a}.sku") != "") & (F.col(f"{a}.sku") == F.col(f"{b}.sku")), 6.0).otherwise(0.0)
    for c, weight in (("quantity", 1.0), ("unit_price", 2.0), ("amount", 2.0)):
        u, v = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        out = out + F.when(u.isNull() | v.isNull(), 0.0).when(F.abs(u - v) <= 0.01, weight).otherwise(-weight)
    return out


def _reading_points(a: str, b: str) -> tuple[Column, Column, Column, Column]:
    """How well two readings of a row agree: 8 for an equal sku, 5 for one that differs by a last letter, 5 for shared words, economics, 6 for a serial
    in common. Also the most that it can be by skus and economics, which are compared first, the part of economics, and whether the skus are equal."""
    (u, v), (stem_u, stem_v) = ([F.col(f"{x}.{c}") for x in (a, b)] for c in ("k", "stem"))
    akin = (F.length(stem_u) >= 5) & ((stem_u == v) | (stem_v == u) | (stem_u == stem_v))
    out = code = F.when((u == "") | (v == ""), 0.0).when(u == v, 8.0).when(akin, 5.0).otherwise(0.0)
    x, y = F.col(f"{a}.words"), F.col(f"{b}.words")
    out = out + F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))) * 5.0
    economics = F.lit(0.0)
    for c, same, other in (("quantity", 6.0, -8.0), ("unit_price", 3.0, -3.0), ("amount", 5.0, -5.0)):
        m, n = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        economics = economics + F.when(m.isNull() | n.isNull(), 0.0).when(F.abs(m - n) < 0.02, same).otherwise(other)
    return out + economics + F.when(F.arrays_overlap(F.col(f"{a}.serials"), F.col(f"{b}.serials")), 6.0).otherwise(0.0), code + economics + 11.0, economics, (u != "") & (u == v)


def _merge_points(a: str, b: str) -> tuple[Column, Column]:
    """As _reading_points, score and most; where the sku stands on several rows just read, economics count once and a half more, and 0.35 goes for each place between the two."""
    out, most, economics, same = _reading_points(a, b)
    again = F.when(same & (F.col(f"{b}.copies") > 1), economics * 1.5 - F.abs(F.col(f"{a}.i") - F.col(f"{b}.i")) * 0.35).otherwise(0.0)
    return out + again, most + again + 0.001  # sums in another order differ by less


def _choices(pairs: DataFrame) -> DataFrame:
    """doc_id, m: in the order of p, each takes its best free s, the first among equals; m lists what is taken (p, minus: the score below zero, s, no). One fold a document over scored pairs."""
    cand = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", (-F.col("score")).alias("minus"), "s", "no"))).alias("c"))
    taken = "array<struct<p:int,minus:double,s:int,no:int>>"
    fold = f"""aggregate(c, named_struct('p', 0, 'used', cast(array() AS array<int>), 'm', cast(array() AS {taken})),
      (acc, x) -> CASE WHEN x.p = acc.p OR array_contains(acc.used, x.s) THEN acc ELSE named_struct('p', x.p, 'used', array_append(acc.used, x.s), 'm', array_append(acc.m, x)) END).m"""
    return cand.select("doc_id", F.expr(fold).alias("m"))


def _assigned(pairs: DataFrame) -> DataFrame:
    """doc_id, p, s, no, score: what _choices takes, a row each."""
    return _choices(pairs).select("doc_id", F.explode("m").alias("x")).select("doc_id", "x.p", "x.s", "x.no", (-F.col("x.minus")).alias("score"))


def _reading(df: DataFrame, *more: Column) -> DataFrame:
    """Rows of a reading with what pairs are scored by; i numbers those of a document in the order of no."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    bare = F.filter(F.transform(F.coalesce("serials", F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("item_name", F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))
    out = df.select("doc_id", F.col("no").cast("int").alias("no"), "sku", "item_name", *map(number, ("quantity", "unit_price", "amount")), bare.alias("serials"), *more)
    key = F.regexp_replace(F.upper(F.coalesce("sku", F.lit(""))), "[^A-Z0-9]+", "")
    out = out.withColumns({"k": key, "words": words}).withColumn("stem", F.regexp_replace("k", "[A-Z]$", ""))
    return out.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "k"))).withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("no")))


def _good(one: DataFrame, two: DataFrame, points, least: float) -> DataFrame:
    """doc_id, p, s, no, score of pairs of rows of a document with `least` points: skus and numbers first, then words and serials of what may still reach them."""
    fields = F.struct("i", "no", "k", "stem", "words", "quantity", "unit_price", "amount", "serials", "copies")
    score, most = points("a", "b")[:2]
    pairs = one.select("doc_id", fields.alias("a")).join(two.select("doc_id", fields.alias("b")), "doc_id").where(most >= least).where(score >= least)
    return pairs.select("doc_id", F.col("a.i").alias("p"), F.col("b.i").alias("s"), F.col("b.no").alias("no"), score.alias("score"))


def best_of_second(first: DataFrame, second: DataFrame, least: float = 6.0) -> DataFrame:
    """doc_id, no, second_no, score: the matched rows of pair_readings alone."""
    one = _reading(first)
    won = _assigned(_good(one, _reading(second), _reading_points, least))
    return one.select("doc_id", "no", F.col("i").alias("p")).join(won, ["doc_id", "p"]).select("doc_id", one["no"], won["no"].alias("second_no"), "score")


def pair_readings(first: DataFrame, second: DataFrame, least: float = 6.0) -> DataFrame:
    """Rows of a first reading, in their order, beside the row of an independent second one that agrees best among those still free (of equal ones
    the first), if by `least` points; then the rows of the second that are left.

    Both: doc_id, no, sku, item_name, quantity, unit_price, amount, serials; numbers of one document and side differ, null documents meet nothing. Returns
    doc_id, no, second_no, score and status (matched, missing, unexpected). Rows of a document meet by equality of the document, all with all; only the choice is a fold."""
    one, two = _reading(first), _reading(second)
    choices = _choices(_good(one, two, _reading_points, least))
    both = one.select("doc_id", "no", "i", F.lit(True).alias("is_first")).unionByName(two.select("doc_id", "no", "i", F.lit(False).alias("is_first"))).join(choices, "doc_id", "left")  # choices are made once
    i, is_first = F.col("i"), F.col("is_first")
    own = F.get(F.filter("m", lambda x: x["p"] == i), F.lit(0))
    free = ~F.coalesce(F.exists("m", lambda x: x["s"] == i), F.lit(False))
    both = both.where(is_first | free).withColumn("x", F.when(is_first, own))
    status = F.when(~is_first, "unexpected").when(F.col("x").isNull(), "missing").otherwise("matched")
    return both.select("doc_id", F.when(is_first, F.col("no")).alias("no"), F.when(is_first, F.col("x.no")).otherwise(F.col("no")).alias("second_no"), (-F.col("x.minus")).alias("score"), status.alias("status"))


def merge_readings(known: DataFrame, read: DataFrame, least: float = 5.0) -> DataFrame:
    """Rows already known, in their order, mended by rows just read, each used once; then the verified rows read that met none.

    A known row takes the best row still free, of equal ones the first, if they agree by 5 points; repeated skus are told apart by economics and by their order. A
    verified row gives its quantity, price and amount, and its serials if they are no more than the quantity; any row fills in a sku or name that is missing.
    known: doc_id, no, sku, item_name, quantity, unit_price, amount, serials; read: the same with verified, only what may be equipment. Numbers of one
    document and side differ. Adds status (mended, kept, added) and read_no. All pairs of a document are scored; a document has few rows."""
    one, two = _reading(known), _reading(read, F.coalesce("verified", F.lit(False)).alias("verified"))
    won = _assigned(_good(one, two, _merge_points, least))
    found = two.select("doc_id", F.col("i").alias("s"), *[F.col(c).alias(f"_{c}") for c in ("no", "sku", "item_name", "quantity", "unit_price", "amount", "serials", "verified")])
    out = one.join(won.select("doc_id", F.col("p").alias("i"), "s"), ["doc_id", "i"], "left").join(found, ["doc_id", "s"], "left")
    sure = F.coalesce("_verified", F.lit(False))
    few = F.coalesce((F.size("_serials") <= F.col("_quantity")) | ~(F.col("_quantity") > 0) | (F.col("_quantity") != F.floor("_quantity")), F.lit(True))
    mended = out.select(
        "doc_id", "no", *[F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) for c in ("sku", "item_name")],
        F.when(sure & (F.col("_quantity") > 0), F.col("_quantity")).otherwise(F.col("quantity")).alias("quantity"), *[F.when(sure, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) for c in ("unit_price", "amount")],
        F.when(sure & few, F.col("_serials")).otherwise(F.col("serials")).alias("serials"), F.when(F.col("s").isNull(), "kept").otherwise("mended").alias("status"), F.col("_no").alias("read_no"),
    )
    free = two.where("verified").join(won.select("doc_id", F.col("s").alias("i")), ["doc_id", "i"], "left_anti")
    added = free.select("doc_id", F.lit(None).cast("int").alias("no"), "sku", "item_name", "quantity", "unit_price", "amount", "serials", F.lit("added").alias("status"), F.col("no").alias("read_no"))
    return mended.unionByName(added)


def greedy_matches(rows: DataFrame, least: float = 6.0) -> DataFrame:
    """In the order of the primary rows, each takes the best secondary row that is still free; of equal ones the first.

    rows: doc_id, side ('primary' or 'secondary'), no, sku, name, quantity, unit_price, amount. A score under `least` is no match; then the
    primary row is `missing`, and secondary rows left over are `unexpected`. Rows with equal numbers are ordered by their other columns.

    Pairs are made by equi-joins on the document and a sku, price or amount in common: without one of these a pair has 4 points at
    most, so nothing over that is lost; a lower `least` joins on the document. Only the assignment over scored pairs is a fold per document."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    r = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "side", F.col("no").cast("int").alias("no"), F.col("sku").cast("string").alias("sku"), F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"), *map(number, ("quantity", "unit_price", "amount")))
    w = Window.partitionBy("doc_id", "side").orderBy("no", "sku", "name", "quantity", "unit_price", "amount")
    words = F.array_distinct(F.filter(F.split(F.lower("name"), r"(?U)\s+"), lambda t: F.length(t) > 2))
    r = r.where("side IN ('primary', 'secondary')").withColumns({"i": F.row_number().over(w), "words": words})

    cell = lambda c: F.floor(F.col(c) * 50)  # noqa: E731  values 0.01 apart lie in cells that are equal or neighbours
    tag = lambda kind, v: F.concat(F.lit(kind), v.cast("string"))
    own = [F.when(F.col("sku") != "", tag("s", F.col("sku")))] + [tag(k, cell(c)) for k, c in (("p", "unit_price"), ("a", "amount"))]
    near = own[:1] + [tag(k, cell(c) + j) for k, c in (("p", "unit_price"), ("a", "amount")) for j in (-1, 0, 1)]
    fields = F.struct("no", "i", "sku", "words", "quantity", "unit_price", "amount")
    side = lambda s, keys, name: r.where(F.col("side") == s).select("doc_id", fields.alias(name), F.explode(F.array_compact(F.array(*(keys if least > 4 else [F.lit("")])))).alias("key"))
    pairs = side("primary", own, "a").join(side("secondary", near, "b"), ["doc_id", "key"])
    pairs = pairs.select("doc_id", F.col("a.i").alias("p"), F.col("b.i").alias("s"), F.col("b.no").alias("no"), _points("a", "b").alias("score")).where(F.col("score") >= least).distinct()

    won = _assigned(pairs).withColumnRenamed("no", "secondary_no")

    out = [F.col("doc_id"), F.col("primary_no"), F.col("secondary_no"), F.col("score"), F.col("status")]
    first, second = (r.where(F.col("side") == s).select(F.col("doc_id").alias("d"), "i", F.col("no").alias(f"{s}_no")) for s in ("primary", "secondary"))
    at = lambda k: (F.col("doc_id") == F.col("d")) & (F.col("i") == F.col(k))  # noqa: E731  null documents meet nothing, so none has won
    one = first.join(won, at("p"), "left").withColumns({"status": F.when(F.col("p").isNull(), "missing").otherwise("matched"), "doc_id": F.col("d")}).select(*out)
    two = second.join(won, at("s"), "left_anti").select(F.col("d").alias("doc_id"), F.lit(None).cast("int").alias("primary_no"), "secondary_no", F.lit(None).cast("double").alias("score"), F.lit("unexpected").alias("status"))
    return one.unionByName(two)


def assign_cells(words: DataFrame, columns: DataFrame) -> DataFrame:
    """Words with the column whose interval holds their centre: a range join within a page. columns: page, name, lo, hi."""
    w = words.withColumn("centre", F.col("x") + F.col("width") / 2)
    return w.join(columns, "page").where("centre >= lo AND centre < hi").drop("centre", "lo", "hi")


def numeric_triples(tokens: DataFrame, profile: tuple[float, float] = (0.03, 0.003)) -> DataFrame:
    """Per row the quantity, price and amount, left to right, whose product fits best; none if nothing fits.
    tokens: page, row, x, value. Joins stay inside a text row, which holds a few numbers."""
    t = [tokens.select("page", "row", F.col("x").alias(f"x{i}"), F.col("value").alias(f"v{i}")) for i in range(3)]
    three = t[0].join(t[1], ["page", "row"]).where("x0 < x1").join(t[2], ["page", "row"]).where("x1 < x2")
    delta = F.abs(F.col("v0") * F.col("v1") - F.col("v2"))
    fits = (F.col("v0") > 0) & (delta <= F.greatest(F.lit(profile[0]), F.abs("v2") * profile[1]))
    best = F.min_by(F.struct(F.col("v0").alias("quantity"), F.col("v1").alias("unit_price"), F.col("v2").alias("amount")), F.struct(delta, F.col("x2") - F.col("x0"), "x0"))
    return three.where(fits).groupBy("page", "row").agg(best.alias("b")).select("page", "row", "b.*")
