"""Tables on pages of positioned words: bands, header columns, cells, rows. Only banding, whose running mean depends on
the order of words, runs in Python, one page at a time; the rest is joins and windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.economics import econ_ok, third_of_three
from ..functions.keys import clean
from ..functions.text import money, quantity

# What names a column, and what ends a table.
COLUMNS: tuple[tuple[str, str], ...] = (
    ("sku", r"^(?:sku|code|model|part|item)(?:no)?$"),
    ("description", r"^(?:description|particulars|details)$"),
    ("quantity", r"^(?:qty|quantity|units?)$"),
    ("unit_price", r"^(?:price|unitprice|rate)$"),
    ("amount", r"^(?:amount|total|value)$"),
)
END = r"^(?:sub\s*total|grand total|total|amount due|gst)\b"
LEAST_COLUMNS = 3
WORDS = "page long, band int, y double, text string, x double, width double"


def band_words(words: DataFrame, floor: float = 4.0, rate: float = 0.7) -> DataFrame:
    """Words with the number of their text row. From top to bottom each word joins the nearest row whose running mean is
    within the tolerance, or opens one. words: page, text, x, y, width, height."""

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x", "text"], ignore_index=True)
        heights = sorted(frame["height"])
        tolerance = max(floor, rate * heights[len(heights) // 2])
        means: list[float] = []
        sizes: list[int] = []
        own: list[int] = []
        for y in frame["y"]:
            near = min(range(len(means)), key=lambda i: abs(means[i] - y), default=None)
            if near is None or abs(means[near] - y) > tolerance:
                means.append(y)
                sizes.append(1)
                own.append(len(means) - 1)
            else:
                sizes[near] += 1
                means[near] += (y - means[near]) / sizes[near]
                own.append(near)
        place = {b: i for i, b in enumerate(sorted(range(len(means)), key=lambda i: means[i]))}
        return frame.assign(band=[place[b] for b in own], y=[means[b] for b in own])[["page", "band", "y", "text", "x", "width"]]

    return words.select(F.col("page").cast("long"), "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]).groupBy("page").applyInPandas(gather, WORDS)


def band_text(banded: DataFrame) -> DataFrame:
    g = banded.groupBy("page", "band").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("w"))
    return g.select("page", "band", F.array_join(F.transform("w", lambda w: w.text), " ").alias("text"))


def header_columns(banded: DataFrame) -> DataFrame:
    """page, header, name, lo, hi: the columns of a page's table. The header is the band that names most columns, the first among
    equals; a column reaches from the middle to its left neighbour to the middle to its right one."""
    bare = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    name = None
    for c, pattern in COLUMNS:
        name = F.when(bare.rlike(pattern), c) if name is None else name.when(bare.rlike(pattern), c)
    named = banded.withColumn("name", name).where("name IS NOT NULL").groupBy("page", "band", "name").agg(F.min_by(F.col("x") + F.col("width") / 2, "x").alias("centre"))
    count = named.groupBy("page", "band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COLUMNS)
    best = count.groupBy("page").agg(F.max_by("band", F.struct("n", -F.col("band"))).alias("band"))
    w = Window.partitionBy("page").orderBy("centre")
    cols = named.join(best, ["page", "band"]).withColumns({"_l": F.lag("centre").over(w), "_r": F.lead("centre").over(w)})
    return cols.select(
        "page", F.col("band").alias("header"), "name", F.coalesce((F.col("_l") + F.col("centre")) / 2, F.lit(float("-inf"))).alias("lo"), F.coalesce((F.col("_r") + F.col("centre")) / 2, F.lit(float("inf"))).alias("hi")
    )


def table_cells(banded: DataFrame) -> DataFrame:
    """page, band and the text of each column, for the bands between the header and the first total below it."""
    cols = header_columns(banded)
    ends = band_text(banded).where(F.lower("text").rlike(END)).join(cols.select("page", "header").distinct(), "page").where("band > header").groupBy("page").agg(F.min("band").alias("last"))
    body = banded.join(cols, "page").where(F.col("band") > F.col("header")).join(ends, "page", "left").where(F.col("last").isNull() | (F.col("band") < F.col("last")))
    centre = F.col("x") + F.col("width") / 2
    cell = body.where((centre >= F.col("lo")) & (centre < F.col("hi"))).groupBy("page", "band", "name").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("w"))
    text = cell.select("page", "band", "name", F.array_join(F.transform("w", lambda w: w.text), " ").alias("t"))
    return text.groupBy("page", "band").pivot("name", [c for c, _ in COLUMNS]).agg(F.first("t"))


def table_rows(words: DataFrame) -> DataFrame:
    """Line items of the tables on pages. A band with a quantity or an amount opens a row; bands of words alone go on with the row
    before them. One missing number is derived from the other two; numbers that contradict each other are left out. A page without a
    header has no rows."""
    cells = table_cells(band_words(words))
    q, p, a = quantity("quantity"), money("unit_price"), money("amount")
    r = cells.withColumns({"q": q, "p": p, "a": a})
    w = Window.partitionBy("page").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("row_no", F.count(F.when(F.col("q").isNotNull() | F.col("a").isNotNull(), 1)).over(w)).where("row_no > 0")
    g = r.groupBy("page", "row_no").agg(
        F.min_by("sku", "band").alias("sku"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", "description"))), lambda x: x.description), " ").alias("description"),
        F.max("q").alias("q"), F.max("p").alias("p"), F.max("a").alias("a"),
    )
    g = g.withColumn("e", third_of_three(F.col("q"), F.col("p"), F.col("a")))
    ok = econ_ok(F.col("e.quantity"), F.col("e.unit_price"), F.col("e.amount"), "evidence")
    number = lambda c: F.when(ok, F.col(f"e.{c}")).alias(c)
    return g.select("page", "row_no", F.nullif(clean("sku"), F.lit("")).alias("sku"), clean("description").alias("item_name"), number("quantity"), number("unit_price"), number("amount"), ok.alias("verified"))


def column_clusters(words: DataFrame, tolerance: float = 18.0) -> DataFrame:
    """page, cluster, x, n: left edges of words gathered in runs whose neighbours are at most so far apart."""
    w = Window.partitionBy("page").orderBy("x")
    r = words.withColumn("_new", F.coalesce(F.col("x") - F.lag("x").over(w) > tolerance, F.lit(True)).cast("int"))
    r = r.withColumn("cluster", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("page", "cluster").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))


def table_direction(bands: DataFrame, headers: DataFrame, key: str = "page") -> DataFrame:
    """key, header_y, direction: 1 if the body of a table lies at larger y than its header, -1 if at smaller.

    A total on one side alone decides. With totals on both, the side with more between header and its nearest total wins: three points for a band with a digit,
    one for a band with a letter; then the nearer total, then 1. Without totals the side with more bands that hold a digit wins, then 1.
    bands: key, y, text; headers: key, header_y (a page may have several)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    b = bands.where("y IS NOT NULL").select(key, "y", F.lower(clean(text)).rlike(END).alias("total"), text.rlike(r"\d").cast("int").alias("digit"), text.rlike("[A-Za-z]").cast("int").alias("letter"))
    h = headers.select(key, "header_y").distinct().join(b, key, "left").withColumn("off", F.col("y") - F.col("header_y"))
    w = Window.partitionBy(key, "header_y")
    h = h.withColumns({"below": F.min(F.when(F.col("total") & (F.col("off") > 0), F.col("off"))).over(w), "above": F.max(F.when(F.col("total") & (F.col("off") < 0), F.col("off"))).over(w)})
    body, points = ~F.col("total"), F.col("digit") * 3 + F.col("letter")
    total = lambda side, what: F.coalesce(F.sum(F.when(side, what)), F.lit(0))
    g = h.groupBy(key, "header_y", "below", "above").agg(
        total(body & (F.col("off") > 0) & (F.col("off") < F.col("below")), points).alias("down"), total(body & (F.col("off") < 0) & (F.col("off") > F.col("above")), points).alias("up"),
        total(F.col("off") > 0, F.col("digit")).alias("plus"), total(F.col("off") < 0, F.col("digit")).alias("minus"),
    )
    under, over = F.col("below").isNotNull(), F.col("above").isNotNull()
    way = (
        F.when(under & ~over, 1).when(over & ~under, -1).when(under & (F.col("down") != F.col("up")), F.when(F.col("down") > F.col("up"), 1).otherwise(-1))
        .when(under, F.when(F.col("below") <= -F.col("above"), 1).otherwise(-1)).when(F.col("plus") >= F.col("minus"), 1).otherwise(-1)
    )
    return g.select(key, "header_y", way.alias("direction"))


def number_places(words: DataFrame, key: list[str]) -> DataFrame:
    """key, id, value, at, decimal: every number in a word, with its place. Several numbers of one word share its width evenly; a single one is at its middle."""
    w = words.withColumn("found", F.regexp_extract_all("text", F.lit(r"(-?\d[\d,]*(?:\.\d{1,2})?)"), F.lit(1)))
    wide = F.greatest(F.coalesce(F.col("width"), F.lit(0.0)), F.lit(0.0))
    each = w.select(*key, F.coalesce("x", F.lit(0.0)).alias("x"), wide.alias("wide"), F.size("found").alias("of"), F.posexplode("found").alias("i", "raw"))
    at = F.when((F.col("of") > 1) & (F.col("wide") > 0), F.col("x") + F.col("wide") * ((F.col("i") + 0.5) / F.col("of"))).otherwise(F.col("x") + F.col("wide") / 2)
    ident = F.concat_ws("|", F.col("x").cast("string"), F.col("wide").cast("string"), F.col("i").cast("string"), "raw")
    return each.select(*key, ident.alias("id"), F.replace("raw", F.lit(","), F.lit("")).try_cast("double").alias("value"), at.alias("at"), F.col("raw").rlike(r"[.,]\d{1,2}$").alias("decimal")).where("value IS NOT NULL")


def numbers_by_column(words: DataFrame, columns: DataFrame, key: list[str], most: int = 8) -> DataFrame:
    """key, quantity, unit_price, amount, score: numbers of a row's words for its three columns, though several may stand in one word.

    Each column takes the nearest eight numbers within 0.72 of the columns' spacing (18 at least), those with decimals first among equals; a count is whole, 1 to 999. Of
    all three different numbers that agree (0.03, or 0.003 of the amount) the nearest to their columns are taken, decimals counting for them, the smallest among equals. Rows
    whose columns are not in order, or where nothing agrees, have none. words: key, text, x, width. columns: key, quantity_x, price_x, amount_x."""
    c = columns.where("quantity_x < price_x AND price_x < amount_x").withColumn("spacing", F.least(F.col("price_x") - F.col("quantity_x"), F.col("amount_x") - F.col("price_x")))
    n = number_places(words, key).distinct().join(c, key)
    radius = F.greatest(F.lit(18.0), F.col("spacing") * 0.72)

    def pool(name, centre, ok):
        near = n.withColumn("d", F.abs(F.col("at") - F.col(centre))).where((F.col("d") <= radius) & ok)
        w = Window.partitionBy(*key).orderBy("d", F.desc("decimal"), "id")
        near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
        return near.select(*key, "spacing", *[F.col(x).alias(f"{x}_{name}") for x in ("id", "value", "d", "decimal")])

    v = F.col("value")
    q, p, a = pool("q", "quantity_x", (v == F.floor(v)) & v.between(1, 999)), pool("p", "price_x", v >= 0).drop("spacing"), pool("a", "amount_x", v >= 0).drop("spacing")
    t = q.join(p, key).join(a, key).where("id_q <> id_p AND id_q <> id_a AND id_p <> id_a")
    t = t.where(F.abs(F.col("value_q") * F.col("value_p") - F.col("value_a")) <= F.greatest(F.lit(0.03), F.abs("value_a") * 0.003))
    bonus = F.when(F.col("decimal_p"), 12).otherwise(0) + F.when(F.col("decimal_a"), 12).otherwise(0)
    score = F.lit(1000.0) - (F.col("d_q") + F.col("d_p") + F.col("d_a")) / F.greatest(F.lit(1.0), F.col("spacing")) * 80 + bonus
    best = t.groupBy(*key).agg(F.max_by(F.struct("value_q", "value_p", "value_a", score.alias("score")), F.struct(score, -F.col("value_q"), -F.col("value_p"), -F.col("value_a"))).alias("b"))
    return best.select(*key, F.col("b.value_q").alias("quantity"), F.col("b.value_p").alias("unit_price"), F.col("b.value_a").alias("amount"), "b.score")
