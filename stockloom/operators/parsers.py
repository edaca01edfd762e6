"""Reading line items out of text: a table of lines, sessions over it, and column expressions for single lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.economics import derived_quantity, econ_ok
from ..functions.keys import clean, compact, norm
from ..functions.similarity import similarity
from ..functions.text import MONEY, model_tokens, money

# What opens and closes the item table of a page, and what a number in a description may measure.
HEADER = (r"\bdescription\b", r"\b(?:qty|quantity|units?)\b", r"\bprice\b")
STOP = r"\b(?:sub\s*total|subtotal|gst\s*\d*%?|amount\s+due|grand\s+total|terms\s*&\s*conditions)\b"
SERIAL_LABEL = r"^(?:s\s*[/.-]?\s*n|serial(?:\s*(?:no\.?|numbers?))?)\s*[:#.-]?\s*(.+)$"
MEASURES = r"\s*(?:ansi\s*)?(?:lumens?|lm|watts?|w|hz|khz|mhz|inch(?:es)?|mm|cm|met(?:er|re)s?|gb|tb|mah)\b"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row. A filter on a plain column repeats what the column computes; one on a generated column cannot."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def same(a: Column, b: Column) -> Column:
    """Equality as a condition on pairs that meet by the document: as a key of their join it would have both sides shuffled again."""
    return (a >= b) & (a <= b)


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, page, line_no, line: form feeds part pages; blank lines are dropped but counted."""
    pages = docs.select(key, F.posexplode(F.split(text, "\f")).alias("page", "p"))
    each = pages.select(key, (F.col("page") + 1).alias("page"), F.posexplode(F.split("p", r"\r?\n")).alias("line_no", "line"))
    return once(each.withColumnRenamed("line", "_raw"), line=clean("_raw")).drop("_raw").where("line <> ''")


def in_table(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines inside an item table: after a header line, before the next total. The last mark decides."""
    low = F.lower("line")
    header = low.rlike(HEADER[0]) & low.rlike(HEADER[1]) & low.rlike(HEADER[2])
    mark = F.when(header, 1).when(low.rlike(STOP), 0)
    w = Window.partitionBy(key, "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({"_mark": mark, "_open": F.last(mark, True).over(w)}).where("_open = 1 AND _mark IS NULL").drop("_mark", "_open")


PRICED = rf"^(.*?)\s*({MONEY})\s+({MONEY})\s*[|/.,;:]*$"


def with_economic_row(lines: DataFrame, line: str = "line", name: str = "e") -> DataFrame:
    """Adds a struct of sku, item_name, quantity, unit_price and amount for priced lines of clean text; null for others.

    The last two amounts are price and amount; amount over price where that is whole, else the count before them, is the
    quantity. A first word with a digit is the sku. Each step is a column of its own, so no pattern runs twice on a line."""
    out = lines.withColumn("_parts", F.split(F.regexp_replace(line, PRICED, "$1\u0001$2\u0001$3"), "\u0001"))
    part = lambda i: F.when(F.size("_parts") == 3, F.get("_parts", F.lit(i)))
    out = out.withColumns({"_left": F.regexp_replace(part(0), r"^\d{1,3}\s*[|\[]\s*", ""), "_p": money(part(1)), "_a": money(part(2))})
    out = out.withColumn("_count", F.nullif(F.regexp_extract("_left", r"(?:^|\s)(\d{1,3}|[Iil|])$", 1), F.lit("")))
    out = out.withColumn("_said", F.trim(F.expr("if(_count IS NULL, _left, left(_left, length(_left) - length(_count)))")))
    out = out.withColumn("_sku", F.regexp_extract("_said", r"^([A-Za-z0-9+._/'-]*\d[A-Za-z0-9+._/'-]*)\s+\S", 1))
    count = F.when(F.col("_count").rlike(r"^[Iil|]$"), F.lit(1.0)).otherwise(F.col("_count").try_cast("double"))
    out = out.withColumns({"_q": F.coalesce(derived_quantity(F.col("_p"), F.col("_a")), count), "_name": F.trim(F.expr("substring(_said, length(_sku) + 1)"))})
    row = F.struct(F.nullif(F.col("_sku"), F.lit("")).alias("sku"), F.col("_name").alias("item_name"), F.col("_q").alias("quantity"), F.col("_p").alias("unit_price"), F.col("_a").alias("amount"))
    return out.withColumn(name, F.when((F.col("_q") > 0) & (F.col("_name") != ""), row)).drop("_parts", "_left", "_p", "_a", "_count", "_said", "_sku", "_q", "_name")


def parse_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Line items of the item tables of a text. A priced line opens a row; serial lines and lines of words up to the next
    one belong to it: rows are sessions over the line table, so no parser state passes between tasks."""
    ln = with_economic_row(in_table(lines_of(docs, key, text), key))
    w = Window.partitionBy(key, "page").orderBy("line_no")
    ln = ln.withColumn("row_no", F.count("e").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("row_no > 0")
    serial = F.nullif(F.regexp_extract(F.lower("line"), SERIAL_LABEL, 1), F.lit(""))
    word = F.col("e").isNull() & serial.isNull() & F.col("line").rlike("[A-Za-z]{3}") & ~F.lower("line").rlike(r"^(?:invoice|customer|date|ref\.|p/o|salesman|terms|shipment no)\b")
    g = ln.groupBy(key, "page", "row_no").agg(
        F.max("e").alias("e"),
        F.array_sort(F.collect_list(F.when(word, F.struct("line_no", "line")))).alias("more"),
        F.array_sort(F.collect_list(F.when(serial.isNotNull(), F.struct("line_no", F.upper(serial).alias("s"))))).alias("serials"),
    )
    found = F.array_distinct(F.filter(F.flatten(F.transform("serials", lambda s: F.split(s.s, r"[\s,;/]+"))), lambda s: s != ""))
    return g.select(key, "page", "row_no", "e.*", F.concat_ws(" ", "e.item_name", F.transform("more", lambda m: m.line)).alias("description"), found.alias("serials"))


def blocks_by_ordinal(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines gathered into blocks, each opened by a printed row number one above that of the block before; other
    numbers open nothing. The chain is a fold over the few numbered lines of a document."""
    n = F.regexp_extract("line", r"^(\d{1,2})[.)|]?\s+\S", 1).try_cast("int")
    numbered = lines.withColumn("n", n).where("n IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "n"))).alias("a"))
    none = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<page:int,line_no:int,n:int>>").alias("opens"))
    step = lambda acc, x: F.when(x.n == acc.last + 1, F.struct(x.n.alias("last"), F.concat(acc.opens, F.array(F.struct(x.page.cast("int").alias("page"), x.line_no.cast("int").alias("line_no"), x.n.alias("n")))).alias("opens"))).otherwise(acc)
    opens = numbered.select(key, F.explode(F.aggregate("a", none, step).opens).alias("o")).select(key, "o.page", "o.line_no", F.col("o.n").alias("block"))
    w = Window.partitionBy(key).orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    ln = lines.join(opens, [key, "page", "line_no"], "left").withColumn("block", F.last("block", True).over(w)).where("block IS NOT NULL")
    return ln.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))), lambda x: x.line), " ").alias("text"))


def zip_columns(codes: DataFrame, names: DataFrame, prices: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of a table that was printed column by column: the k-th code, name and price belong together. Only if all three have as many."""
    n = Window.partitionBy(key)
    numbered = [d.withColumns({"k": F.row_number().over(n.orderBy("ordinal")), f"n{i}": F.count(F.lit(1)).over(n)}).drop("ordinal") for i, d in enumerate((codes, names, prices))]
    out = numbered[0].join(numbered[1], [key, "k"]).join(numbered[2], [key, "k"])
    return out.where("n0 = n1 AND n1 = n2").drop("n0", "n1", "n2")


def quantity_is_specification(name: str | Column, quantity: str | Column) -> Column:
    """Whether the quantity stands before a unit of measure in the description: 5500 lumens is no count."""
    n, q = (F.col(x) if isinstance(x, str) else x for x in (name, quantity))
    number = F.regexp_replace(q.cast("decimal(18,4)").cast("string"), r"\.?0+$", "")
    return F.coalesce((q > 0) & F.regexp_like(F.lower(n), F.concat(F.lit(r"(?:^|\b)"), F.replace(number, F.lit("."), F.lit(r"\.")), F.lit(MEASURES))), F.lit(False))


def direct_candidates(rows: DataFrame, key: list[str], name: str = "line") -> DataFrame:
    """All pairs of amounts on a line with a quantity that fits them, best first; null economics if none fits.

    Joins stay within a line's few numbers: the tokens are exploded twice and paired by place."""
    tok = rows.select(*key, name, F.posexplode(F.regexp_extract_all(name, F.lit(f"({MONEY})"), F.lit(1))).alias("i", "t"))
    p = tok.select(*key, F.col("i").alias("pi"), money("t").alias("unit_price"))
    a = tok.select(*key, F.col("i").alias("ai"), money("t").alias("amount"))
    pairs = p.join(a, key).where("pi < ai").withColumn("quantity", derived_quantity(F.col("unit_price"), F.col("amount")))
    pairs = pairs.where(econ_ok(F.col("quantity"), F.col("unit_price"), F.col("amount"), "consensus"))
    best = pairs.groupBy(*key).agg(F.max_by(F.struct("quantity", "unit_price", "amount"), F.struct("ai", "pi")).alias("b"))
    return rows.select(*key).distinct().join(best, key, "left").select(*key, "b.quantity", "b.unit_price", "b.amount")


def word_runs(lines: DataFrame, wanted: DataFrame, key: str = "doc_id", *carry: str) -> DataFrame:
    """One row for each line and each k wanted in its document that a run of the line's words spells, as bare upper-case letters and digits.
    lines: key, page, line_no, line and the columns to carry; wanted: key, k.

    Lines and codes meet by the document alone, so that neither leaves the task its document is in; runs are only made where the letters and digits stand in a row."""
    w = lines.withColumn("w", F.filter(F.split(norm("line"), " "), lambda t: t != ""))
    w = w.withColumns({"flat": F.upper(F.array_join("w", "")), "apart": F.upper(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))})
    one_word = F.contains("apart", F.concat(F.lit(" "), "k", F.lit(" ")))  # most codes are one word, and no run need be joined to see that
    met = wanted.where("k <> ''").select(key, "k").distinct().join(w, key).where(F.contains("flat", "k") & (one_word | spelled(F.col("w"), F.col("k"))))
    return met.select(key, "page", "line_no", "line", *carry, "k")


def spelled(words: Column, k: Column) -> Column:
    """Whether a run of whole words, joined, is the bare code k."""
    to = lambda i: F.least(F.size(words), i + F.length(k) - 1)  # noqa: E731  each word has a character at least
    return F.exists(F.sequence(F.lit(1), F.size(words)), lambda i: F.exists(F.sequence(i, to(i)), lambda j: F.upper(F.array_join(F.slice(words, i, j - i + 1), "")) == k))


def evidence_lines(values: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """First line of the document that holds a value as whole words, compared as bare letters and digits; null if none does.
    values: key, field, value.

    A value may be written with other marks and spaces than the line has (MX-12 and MX12), but it begins and ends where words do,
    so MX12 is not in MX123. Lines and values meet inside their document."""
    v = values.withColumn("k", compact("value"))
    hit = word_runs(lines.select(key, "page", "line_no", "line"), v.select(key, "k"), key)
    first = v.where("k <> ''").select(key, "field", "value", "k").distinct().join(hit, [key, "k"]).groupBy(key, "field", "value").agg(F.min(F.struct("page", "line_no", "line")).alias("at"))
    return values.join(first, [key, "field", "value"], "left").select(key, "field", "value", "at.page", "at.line_no", "at.line")


def serial_conflicts(rows: DataFrame, key: str = "doc_id", row: str = "row_no", serials: str = "serials", quantity: str = "quantity") -> DataFrame:
    """Rows whose serials also stand on another row of the document, or outnumber a whole quantity. Both rows are marked."""
    s = rows.select(key, row, F.explode(F.transform(serials, lambda x: F.upper(F.trim(x)))).alias("s")).distinct()
    shared = s.groupBy(key, "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    conflict = s.join(shared, [key, "s"]).select(key, row).distinct().withColumn("conflict", F.lit(True))
    q = F.col(quantity)
    many = F.coalesce((q > 0) & (q == F.floor(q)) & (F.size(F.array_distinct(serials)) > q), F.lit(False))
    return rows.join(conflict, [key, row], "left").withColumns({"serial_conflict": F.coalesce("conflict", F.lit(False)), "too_many_serials": many}).drop("conflict")


def move_warranty_serials(rows: DataFrame, key: str = "doc_id", order: str = "row_no", kind: str = "class", serials: str = "serials") -> DataFrame:
    """Serials printed under a warranty row go to the equipment row before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col(kind) == "equipment", F.col(order)), True).over(w)
    r = rows.withColumn("_owner", F.when(F.col(kind) == "warranty", owner).otherwise(F.col(order)))
    given = r.where(F.col("_owner").isNotNull() & (F.col("_owner") != F.col(order))).groupBy(key, F.col("_owner").alias(order)).agg(F.flatten(F.collect_list(serials)).alias("_more"))
    none = F.array().cast("array<string>")
    out = r.join(given, [key, order], "left")
    own = F.when(F.col("_owner") == F.col(order), F.col(serials)).otherwise(F.when(F.col("_owner").isNull(), F.col(serials)).otherwise(none))
    return out.withColumn(serials, F.array_distinct(F.concat(F.coalesce(own, none), F.coalesce("_more", none)))).drop("_owner", "_more")


def serials_that_are_models(rows: DataFrame, key: str = "doc_id", name: str = "item_name", serials: str = "serials") -> DataFrame:
    """Takes out serials that are a model code anywhere in the document."""
    codes = rows.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(model_tokens(name)))).alias("_codes"))
    return rows.join(codes, key).withColumn(serials, F.filter(serials, lambda s: ~F.array_contains("_codes", compact(s)))).drop("_codes")


def same_economics_pairs(rows: DataFrame, key: str = "doc_id", row: str = "row_no") -> DataFrame:
    """Pairs of rows of a document that name one thing: equal economics, and equal skus or mostly equal words."""
    k = F.concat_ws("|", *[F.col(c).cast("decimal(18,2)").cast("string") for c in ("quantity", "unit_price", "amount")])
    r = rows.withColumn("econ", k)
    a, b = (r.select(key, "econ", *[F.col(c).alias(f"{c}_{s}") for c in (row, "sku", "item_name")]) for s in ("a", "b"))
    pairs = a.join(b, [key, "econ"]).where(F.col(f"{row}_a") < F.col(f"{row}_b"))
    same = ((compact("sku_a") != "") & (compact("sku_a") == compact("sku_b"))) | (similarity("item_name_a", "item_name_b", "f15") >= 0.6)
    return pairs.where(same).select(key, f"{row}_a", f"{row}_b")
