"""Registered queries about rows that wrap, stack or scatter over lines: orders printed that way and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import consolidation, parsers, recovery, regions
from ..sources.cut import cut
from .documents import LINES_SQL, _lines
from .queries import query

NUMBERED_SQL = f"""{LINES_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, l_partkey, q, a) AS INT) AS k, 'MX' || CAST(l_partkey AS VARCHAR) AS code, CAST(a AS DOUBLE) AS x,
 l_suppkey % 7 AS style FROM li)"""


def _numbered(spark, d):
    w = Window.partitionBy("doc_id").orderBy("ord", "l_partkey", "q", "a")
    return _lines(spark, d).withColumns({"k": F.row_number().over(w), "code": F.concat(F.lit("MX"), F.col("l_partkey").cast("string")), "style": F.col("l_suppkey") % 7})


def _printed(rows, row, before, after):
    """One text a document: rows in their order between fixed lines."""
    g = rows.withColumn("t", row).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", "t")))["t"], "\n").alias("t"))
    return g.select("doc_id", F.concat(before, F.lit("\n"), F.col("t"), F.lit("\n"), after).alias("text"))


def _cash(c):
    return F.format_number(F.col(c).cast("double"), 2)


def _n(c):
    return F.col(c).cast("string")


def _lines_of(*parts):
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def sparse_texts(spark, d):
    """One thing a line. The style decides what the reader meets: 0 plain, 1 the count last, 2 an accessory, 3 a name too far below, 4 a remark before the count, 5 brackets and currencies, 6 no count."""
    name = F.concat_ws(" ", "p_name", F.lit("projector"), "code")
    style = lambda i, *parts: (F.col("style") == i, _lines_of(_n("k"), *parts))
    cases = [
        style(0, name, _n("q"), _cash("p"), _cash("a")), style(1, "see below", name, _cash("p"), _cash("a"), _n("q")), style(2, F.concat_ws(" ", "p_name", F.lit("cable")), _n("q"), _cash("p"), _cash("a")),
        style(3, "one", "two", "three", "four", name, _n("q"), _cash("p"), _cash("a")), style(4, name, "remark", _n("q"), _cash("p"), _cash("a")),
        style(5, F.concat(F.lit("[ "), name, F.lit(" |")), _n("q"), F.concat(F.lit("SGD "), _cash("p")), F.concat(F.lit("S$"), _cash("a"))), style(6, name, _cash("p"), _cash("a"), *["remark"] * 6),
    ]
    row = F.coalesce(*[F.when(hit, text) for hit, text in cases])
    return _printed(_numbered(spark, d), row, F.lit("TAX INVOICE"), F.lit("Sub Total"))


@query(f"""WITH {NUMBERED_SQL}, z AS (SELECT *, CASE WHEN style = 6 THEN CASE WHEN round(x / p) BETWEEN 1 AND 999 AND abs(x / p - round(x / p)) < 0.001::DOUBLE THEN round(x / p) END ELSE CAST(q AS DOUBLE) END AS n FROM r WHERE style IN (0, 1, 5, 6))
SELECT doc_id, k AS ordinal, code AS sku, p_name || ' projector ' || code AS item_name, n AS quantity, p AS unit_price, x AS amount, abs(n * p - x) > greatest(0.02::DOUBLE, abs(x) * 0.001::DOUBLE) AS needs_review FROM z WHERE n > 0""")
def sparse_row_recovery(spark, d):
    """All orders with every word and number on a line of its own, read back."""
    rows = recovery.sparse_rows(parsers.lines_of(sparse_texts(spark, d)))
    return rows.select("doc_id", "ordinal", "sku", "item_name", "quantity", "unit_price", "amount", "needs_review")


def wrapped_texts(spark, d):
    """Numbered rows whose model, and in some styles name, stand on lines below. One order in five is a delivery order; amounts of style 3 do not agree."""
    name, model = F.concat_ws(" ", "p_name", F.lit("projector")), F.concat(F.lit("MODEL: Acme "), F.col("code"))
    numbers = F.concat_ws(" ", _n("q"), _cash("p"), F.format_number(F.col("a").cast("double") * F.when(F.col("style") == 3, 2).otherwise(1), 2))
    opens = lambda t: F.concat_ws(" ", F.concat(_n("k"), F.lit(".")), t, numbers)
    style = lambda i, *parts: (F.col("style") == i, _lines_of(*parts))
    cases = [
        style(0, opens(name), model), style(1, opens(F.lit("RE: room")), name, model), style(2, opens(name), model, F.concat(F.lit("Replaced with Acme N"), F.col("code"))), style(3, opens(name), model),
        style(4, opens(name)), style(5, opens(F.concat_ws(" ", "p_name", F.lit("installation"))), model), style(6, opens(F.lit("RE: replacement setup")), model, name),
    ]
    title = F.when(F.col("doc_id") % 5 == 0, "DELIVERY ORDER for invoice below").otherwise("TAX INVOICE")
    after = F.lit("SUB TOTAL 1.00\n9. late projector 1 5.00 5.00\nMODEL: ZZ1")
    return _printed(_numbered(spark, d), F.coalesce(*[F.when(hit, text) for hit, text in cases]), title, after)


@query(f"""WITH {NUMBERED_SQL} SELECT doc_id, k AS ordinal, code AS sku, p_name || ' projector' AS item_name, CAST(q AS DOUBLE) AS quantity, p AS unit_price, x AS amount, style = 2 AS needs_review
FROM r WHERE doc_id % 5 <> 0 AND style IN (0, 1, 2, 6) AND abs(q * p - x) <= greatest(0.03::DOUBLE, abs(x) * 0.002::DOUBLE)""")
def wrapped_row_recovery(spark, d):
    """All orders as numbered rows that wrap over lines, read back."""
    rows = recovery.wrapped_rows(wrapped_texts(spark, d))
    return rows.select("doc_id", "ordinal", "sku", "item_name", "quantity", "unit_price", "amount", "needs_review")


def stacked_texts(spark, d):
    """Description, then numbers. A second page is a delivery order with the same table, a third one has the first row again."""
    r = _numbered(spark, d)
    sn = F.lpad(_n("l_suppkey"), 6, "0")
    numbers = F.concat_ws(" ", _n("q"), F.concat(F.lit("SGD "), _cash("p")), F.when(F.col("style") == 1, F.lit("5.00%")), F.format_number(F.col("a").cast("double") * F.when(F.col("style") == 3, 2).otherwise(1), 2))
    row = _lines_of(
        F.col("p_name"), F.concat(F.lit("projector "), F.col("code")), F.when(F.col("style") == 2, "IN STOCK"), numbers, F.when(F.col("style") < 4, "Warranty: 1 year"), F.when(F.col("style") < 4, "service centre"),
        F.when(F.col("style") != 5, F.concat(F.lit("S/N: SN"), sn, F.lit(", SA"), sn)), F.when(F.col("style") == 6, F.concat(F.lit("SB"), sn)), F.when(F.col("style") == 0, "S/N: N/A"),
    )
    head = "Description Qty Unit Price Amount"
    text = _printed(r, row, F.lit(f"TAX INVOICE\nCustomer: A\n{head}"), F.lit("Sub Total 1.00\nPayable by 1 2.00 2.00"))
    first = r.where("k = 1").select("doc_id", _lines_of(F.col("p_name"), "speaker", numbers).alias("again"))
    return text.join(first, "doc_id").select("doc_id", F.concat_ws("\f", "text", F.concat(F.lit(f"DELIVERY ORDER\n{head}\n"), F.col("again")), F.concat(F.lit(f"{head}\n"), F.col("again"))).alias("text"))


@query(f"""WITH {NUMBERED_SQL}, s AS (SELECT *, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS n FROM r WHERE style <> 3 AND abs(q * p - x) <= greatest(0.08::DOUBLE, abs(x) * 0.01::DOUBLE))
SELECT doc_id, 1 AS page, p_name || ' projector ' || code AS item_name, CAST(q AS DOUBLE) AS quantity, p AS unit_price, x AS amount,
 CASE WHEN style = 5 THEN '' WHEN style = 6 THEN 'SN' || n || ',SA' || n || ',SB' || n ELSE 'SN' || n || ',SA' || n END AS serials, CASE style WHEN 5 THEN 0 WHEN 6 THEN 3 ELSE 2 END > q AS needs_review FROM s
UNION ALL SELECT doc_id, 3, p_name || ' speaker', CAST(q AS DOUBLE), p, x, '', FALSE FROM s WHERE k = 1""")
def stacked_row_recovery(spark, d):
    """All orders printed description first, on three pages of which the second is another paper, read back."""
    rows = recovery.stacked_rows(parsers.lines_of(stacked_texts(spark, d)))
    return rows.select("doc_id", "page", "item_name", "quantity", "unit_price", "amount", F.array_join("serials", ",").alias("serials"), "needs_review")


def continued_texts(spark, d):
    """Priced lines with a description below, serials between its lines; style 3 does not agree, style 4 names no equipment."""
    numbers = F.concat_ws(" ", _n("q"), _cash("p"), F.format_number(F.col("a").cast("double") * F.when(F.col("style") == 3, 2).otherwise(1), 2))
    row = _lines_of(F.concat_ws(" ", "code", "p_name", numbers), F.when(F.col("style") != 4, "ceiling projector"), F.when(F.col("style") < 3, "S/N: AB123456"), F.when(F.col("style") == 1, "white"))
    return _printed(_numbered(spark, d), row, F.lit("TAX INVOICE"), F.lit("Sub Total 1.00\nprojector notes"))


@query(f"""WITH {NUMBERED_SQL} SELECT doc_id, code AS sku, p_name || ' ceiling projector' || CASE WHEN style = 1 THEN ' white' ELSE '' END AS item_name, CAST(q AS DOUBLE) AS quantity, p AS unit_price, x AS amount
FROM r WHERE style NOT IN (3, 4) AND abs(q * p - x) <= greatest(0.06::DOUBLE, abs(x) * 0.005::DOUBLE) AND p > 0""")
def continued_row_recovery(spark, d):
    """All orders as priced lines whose descriptions go on below, read back."""
    rows = recovery.continued_rows(parsers.lines_of(continued_texts(spark, d)))
    return rows.select("doc_id", "sku", "item_name", "quantity", "unit_price", "amount")


def fragments(spark, d):
    """Order lines with pieces of them, by style: 0 a shorter text without code, 1 the same code under another name, 2 a text too short, 3 a cent more, 4 two pieces that only meet over the whole line, 5 another code."""
    r = _numbered(spark, d).withColumn("name", F.concat_ws(" ", "p_name", F.lit("ceiling projector"), "code")).withColumn("p", F.col("p").cast("double"))
    none, code = F.lit(""), F.col("code")

    def piece(i, sku, name, more=0.0, review=False):
        return F.struct(F.lit(i).alias("i"), sku.alias("sku"), name.alias("name"), (F.col("p") + more).alias("p"), F.lit(review).alias("needs_review"))

    front, back = F.concat_ws(" ", "p_name", F.lit("ceiling")), F.concat_ws(" ", F.lit("ceiling projector"), "code")
    pieces = (
        F.when(F.col("style") == 0, F.array(piece(2, none, front))).when(F.col("style") == 1, F.array(piece(2, code, F.lit("lamp"), review=True))).when(F.col("style") == 2, F.array(piece(2, none, F.lit("projector"))))
        .when(F.col("style") == 3, F.array(piece(2, none, front, 0.01))).when(F.col("style") == 4, F.array(piece(0, none, front), piece(2, none, back))).when(F.col("style") == 5, F.array(piece(2, F.concat(code, F.lit("B")), F.col("name"))))
        .otherwise(F.array().cast("array<struct<i:int,sku:string,name:string,p:double,needs_review:boolean>>"))
    )
    r = r.select("doc_id", "k", "q", "a", F.explode(F.concat(F.array(piece(1, code, F.col("name"))), pieces)).alias("x"))
    return r.select("doc_id", (F.col("k") * 10 + F.col("x.i")).alias("row_no"), "x.sku", F.col("x.name").alias("item_name"), F.col("q").cast("double").alias("quantity"), F.col("x.p").alias("unit_price"), F.col("a").cast("double").alias("amount"), "x.needs_review")


PIECES_SQL = f"""{NUMBERED_SQL}, b AS (SELECT *, p_name || ' ceiling projector ' || code AS name, p_name || ' ceiling' AS front, 'ceiling projector ' || code AS back FROM r),
f AS (SELECT doc_id, k * 10 + 1 AS row_no, code AS sku, name AS item_name, CAST(q AS DOUBLE) AS quantity, p AS unit_price, x AS amount, FALSE AS needs_review FROM b
 UNION ALL SELECT doc_id, k * 10 + 2, CASE style WHEN 1 THEN code WHEN 5 THEN code || 'B' ELSE '' END, CASE style WHEN 1 THEN 'lamp' WHEN 2 THEN 'projector' WHEN 4 THEN back WHEN 5 THEN name ELSE front END, CAST(q AS DOUBLE), CASE WHEN style = 3 THEN p + 0.01::DOUBLE ELSE p END, x, style = 1 FROM b WHERE style < 6
 UNION ALL SELECT doc_id, k * 10, '', front, CAST(q AS DOUBLE), p, x, FALSE FROM b WHERE style = 4)"""


@query(f"""WITH RECURSIVE {PIECES_SQL}, n AS (SELECT *, trim(regexp_replace(lower(item_name), '[^a-z0-9]+', ' ', 'g')) AS d FROM f),
l AS (SELECT a.doc_id, a.row_no AS a, b.row_no AS b FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.row_no <> b.row_no AND a.quantity = b.quantity AND abs(a.unit_price - b.unit_price) <= 0.01::DOUBLE
 WHERE CASE WHEN a.sku <> '' AND b.sku <> '' THEN a.sku = b.sku ELSE least(length(a.d), length(b.d)) >= 12 AND (contains(a.d, b.d) OR contains(b.d, a.d)) END),
reach AS (SELECT doc_id, row_no AS a, row_no AS b FROM n UNION SELECT reach.doc_id, reach.a, l.b FROM reach JOIN l ON l.doc_id = reach.doc_id AND l.a = reach.b),
root AS (SELECT doc_id, a AS row_no, min(b) AS root FROM reach GROUP BY 1, 2),
s AS (SELECT n.*, root, CASE WHEN sku <> '' THEN 30 ELSE 0 END + CASE WHEN abs(quantity * unit_price - amount) <= greatest(0.06::DOUBLE, abs(amount) * 0.005::DOUBLE) THEN 40 ELSE 0 END + least(20, length(d) / 5.0::DOUBLE) - CASE WHEN needs_review THEN 10 ELSE 0 END AS strength FROM n JOIN root USING (doc_id, row_no))
SELECT doc_id, root AS row_no, arg_max(sku, (strength, row_no)) AS sku, arg_max(item_name, (strength, row_no)) AS item_name, max(quantity) AS quantity, arg_max(unit_price, (strength, row_no)) AS unit_price, max(amount) AS amount,
 arg_max(needs_review, (strength, row_no)) AS needs_review, count(*) AS merged FROM s GROUP BY doc_id, root""")
def fragment_consolidation(spark, d):
    """All order lines with fragments of them beside, made one again."""
    return consolidation.consolidate_fragments(fragments(spark, d))


def readings(spark, d):
    """Each order line as three sources read it: a without prices in style 2, b without code and for some styles, c with another code in style 0 and without count."""
    r = _numbered(spark, d)
    none, q, p, a = F.lit(None).cast("double"), F.col("q").cast("double"), F.col("p").cast("double"), F.col("a").cast("double")
    name, empty = F.concat_ws(" ", "p_name", F.lit("projector")), F.array().cast("array<string>")

    def read(source, after, where, sku, item_name, quantity, unit_price, amount, serials, review):
        row = F.struct((F.col("k") + after).alias("row_no"), F.lit(source).alias("source"), F.col("k").alias("ordinal"), sku.alias("sku"), item_name.alias("item_name"), quantity.alias("quantity"), unit_price.alias("unit_price"), amount.alias("amount"), serials.alias("serials"), review.alias("needs_review"))
        return F.when(where, row)

    style, sn = F.col("style"), F.concat(F.lit("SN"), F.col("l_suppkey").cast("string"))
    one = read("a", 0, F.lit(True), F.col("code"), name, q, F.when(style != 2, p), F.when(style != 2, a), empty, F.lit(False))
    two = read("b", 100_000, style < 3, F.lit(""), F.concat(F.lit("the "), name, F.lit(" white")), q, F.when(style != 1, p), F.when(style != 1, a), F.array(sn), style == 2)
    three = read("c", 200_000, style.isin(0, 3), F.concat(F.col("code"), F.when(style == 0, "X").otherwise("")), name, none, p, a, empty, F.lit(False))
    return r.select("doc_id", F.inline(F.array_compact(F.array(one, two, three))))


def _witnesses(out):
    lists = {c: F.array_join(c, ",").alias(c) for c in ("serials", "sources")}
    return out.select(*[lists.get(c, F.col(c)) for c in out.columns if c != "row_no"])


@query(f"""WITH {NUMBERED_SQL} SELECT doc_id, k AS ordinal, CASE WHEN style = 0 THEN '' ELSE code END AS sku, CASE WHEN style <> 0 THEN 'a' END AS sku_source, p_name || ' projector' AS item_name, 'a' AS item_name_source, CAST(q AS DOUBLE) AS quantity, 'a' AS quantity_source,
 p AS unit_price, CASE WHEN style = 2 THEN 'b' ELSE 'a' END AS unit_price_source, x AS amount, CASE WHEN style = 2 THEN 'b' ELSE 'a' END AS amount_source, CASE WHEN style < 3 THEN 'SN' || CAST(l_suppkey AS VARCHAR) END AS serials, CASE WHEN style < 3 THEN 'b' END AS serials_source,
 CASE style WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'a,b' WHEN 2 THEN 'a,b' WHEN 3 THEN 'a,c' ELSE 'a' END AS sources, CASE style WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS members, style = 0 AS needs_review FROM r""")
def witness_consolidation(spark, d):
    """All order lines from the readings of three sources, field by field."""
    return _witnesses(consolidation.consolidate_witnesses(readings(spark, d)))


@query(f"""WITH {NUMBERED_SQL}, n AS (SELECT *, CASE WHEN style = 6 THEN CASE WHEN round(x / p) BETWEEN 1 AND 999 AND abs(x / p - round(x / p)) < 0.001::DOUBLE THEN round(x / p) END ELSE CAST(q AS DOUBLE) END AS n FROM r),
f AS (SELECT *, doc_id % 5 <> 0 AND style IN (0, 1, 2, 6) AND abs(q * p - x) <= greatest(0.03::DOUBLE, abs(x) * 0.002::DOUBLE) AS w, style IN (0, 1, 5, 6) AND coalesce(n > 0, FALSE) AS s, abs(n * p - x) > greatest(0.02::DOUBLE, abs(x) * 0.001::DOUBLE) AS doubt FROM n),
g AS (SELECT *, CASE WHEN w AND (NOT s OR doubt) THEN 'wrapped' ELSE 'sparse' END AS src FROM f WHERE w OR s)
SELECT doc_id, k AS ordinal, code AS sku, src AS sku_source, p_name || ' projector' || CASE WHEN w THEN '' ELSE ' ' || code END AS item_name, CASE WHEN w THEN 'wrapped' ELSE 'sparse' END AS item_name_source, CASE WHEN src = 'sparse' THEN n ELSE CAST(q AS DOUBLE) END AS quantity, src AS quantity_source,
 p AS unit_price, src AS unit_price_source, x AS amount, src AS amount_source, CAST(NULL AS VARCHAR) AS serials, CAST(NULL AS VARCHAR) AS serials_source, CASE WHEN w AND s THEN 'sparse,wrapped' WHEN w THEN 'wrapped' ELSE 'sparse' END AS sources, CASE WHEN w AND s THEN 2 ELSE 1 END AS members,
 CASE WHEN w AND s THEN FALSE WHEN w THEN style = 2 ELSE doubt END AS needs_review FROM g""")
def recovery_union(spark, d):
    """All orders printed twice, wrapped on one page and scattered on the next, read by every reader and made one."""
    texts = wrapped_texts(spark, d).withColumnRenamed("text", "one").join(sparse_texts(spark, d).withColumnRenamed("text", "two"), "doc_id").select("doc_id", F.concat_ws("\f", "one", "two").alias("text"))
    return _witnesses(consolidation.consolidate_witnesses(recovery.recovered(texts)))


def region_texts(spark, d):
    """Each order line on one, two or three lines of its invoice, by style; style 5 prints no amount, style 6 the same again for another thing."""
    name = F.concat_ws(" ", "p_name", F.lit("projector"))
    numbers = F.concat_ws(" ", _n("q"), _cash("p"), F.when(F.col("style") != 5, _cash("a")))
    row = F.when(F.col("style") < 2, F.concat_ws(" ", "code", name, numbers)).when(F.col("style") < 4, _lines_of(F.concat_ws(" ", "code", name), numbers)).otherwise(_lines_of(F.col("code"), name, numbers))
    row = F.when(F.col("style") == 6, _lines_of(row, F.concat(F.col("code"), F.lit("Z")), F.concat(name, F.lit(" white")), numbers)).otherwise(row)
    return _printed(_numbered(spark, d), row, F.lit("TAX INVOICE"), F.lit("Thank you"))


def _source_lines(spark, d):
    lines = parsers.lines_of(region_texts(spark, d))
    w = Window.partitionBy("doc_id").orderBy("page", "line_no")
    return lines.select("doc_id", F.lit("raw").alias("source"), F.row_number().over(w).alias("n"), "line")


def _region_rows(spark, d):
    """Rows as a reader had them: style 1 with a wrong code, style 0 with its own, the rest without; a model in styles 2 and 6."""
    r = _numbered(spark, d)
    style, code = F.col("style"), F.col("code")
    sku = F.when(style == 0, code).when(style == 1, F.concat(F.lit("Q"), code)).otherwise("")
    return r.select("doc_id", F.col("k").alias("row_no"), sku.alias("sku"), F.when(style.isin(2, 6), code).otherwise("").alias("model"), F.concat_ws(" ", "p_name", F.lit("projector")).alias("item_name"), F.col("q").cast("double").alias("quantity"), F.col("p").alias("unit_price"), F.col("a").cast("double").alias("amount"), "style", "code")


REGION_SQL = f"""{NUMBERED_SQL}, m AS (SELECT *, p_name || ' projector' AS name, CAST(q AS VARCHAR) || ' ' || format('{{:,.2f}}', p) || CASE WHEN style = 5 THEN '' ELSE ' ' || format('{{:,.2f}}', x) END AS nums FROM r),
t AS (SELECT doc_id, 0 AS k, 0 AS j, 'TAX INVOICE' AS line FROM (SELECT DISTINCT doc_id FROM r) UNION ALL SELECT doc_id, k, unnest(range(6)), unnest(CASE WHEN style < 2 THEN [code || ' ' || name || ' ' || nums] WHEN style < 4 THEN [code || ' ' || name, nums] WHEN style < 6 THEN [code, name, nums] ELSE [code, name, nums, code || 'Z', name || ' white', nums] END) FROM m
 UNION ALL SELECT doc_id, 1000000, 0, 'Thank you' FROM (SELECT DISTINCT doc_id FROM r)),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS n FROM t WHERE line IS NOT NULL),
w AS (SELECT doc_id, n AS first, span, array_to_string(CASE span WHEN 1 THEN [line] WHEN 2 THEN [line, b] ELSE [line, b, c] END, ' ') AS text FROM (SELECT *, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY n)), (SELECT unnest([1, 2, 3]) AS span)
 WHERE span = 1 OR (span = 2 AND b IS NOT NULL) OR c IS NOT NULL),
v AS (SELECT *, [CAST(replace(z, ',', '') AS DOUBLE) FOR z IN regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?')] AS nums, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM w),
p AS (SELECT m.doc_id, k AS row_no, first, span, text, CASE WHEN list_contains(nums_v, CAST(q AS DOUBLE)) THEN 1.2::DOUBLE ELSE 0 END + CASE WHEN list_contains(nums_v, p) THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN list_contains(nums_v, x) THEN 2.5::DOUBLE ELSE 0 END
 + CAST(len(list_intersect(told, words)) AS DOUBLE) / len(told) * 3.0::DOUBLE AS score FROM (SELECT *, list_distinct(list_filter(string_split(name, ' '), lambda z: length(z) >= 3)) AS told FROM m) m JOIN (SELECT doc_id, first, span, text, nums AS nums_v, words FROM v) USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, row_no ORDER BY score DESC, span, first) AS rank FROM p WHERE score >= 2.5),
top AS (SELECT * FROM o WHERE rank = 1), nxt AS (SELECT o.* FROM o JOIN top USING (doc_id, row_no) WHERE o.text <> top.text QUALIFY row_number() OVER (PARTITION BY o.doc_id, o.row_no ORDER BY o.rank) = 1),
best AS (SELECT top.doc_id, top.row_no, top.first, top.span, top.score, top.text FROM top LEFT JOIN nxt USING (doc_id, row_no) WHERE NOT coalesce(abs(top.score - nxt.score) < 0.35::DOUBLE AND NOT (top.first < nxt.first + nxt.span AND nxt.first < top.first + top.span), FALSE))"""


@query(f"WITH {REGION_SQL} SELECT doc_id, row_no, CAST(first AS INT) AS first, CAST(span AS INT) AS span, round(score, 6) AS score, text FROM best")
def best_raw_region(spark, d):
    """Where each order line stands in its invoice, found without its code; lines that could stand in two places have none."""
    found = regions.best_regions(_region_rows(spark, d), _source_lines(spark, d), "sku")
    return found.select("doc_id", "row_no", "first", "span", F.round("score", 6).alias("score"), "text")


@query(f"""WITH {REGION_SQL}, c AS (SELECT m.*, best.text, coalesce(regexp_replace(upper(best.text), '[^A-Z0-9]+', '', 'g'), '') AS held, coalesce([z FOR z IN regexp_extract_all(best.text, '[A-Za-z0-9][A-Za-z0-9+._/-]{{2,}}') IF regexp_matches(z, '[A-Za-z]') AND regexp_matches(z, '[0-9]')], []) AS seen FROM m LEFT JOIN best ON best.doc_id = m.doc_id AND best.row_no = m.k),
s AS (SELECT *, list_distinct(seen) AS uniq, contains(held, code) AS printed FROM c),
z AS (SELECT doc_id, k AS row_no, code, style, printed, CASE WHEN len(uniq) = 1 THEN uniq[1] END AS region FROM s),
y AS (SELECT *, CASE WHEN style = 0 AND printed THEN 'kept' WHEN style IN (2, 6) AND printed THEN 'direct' WHEN style = 0 AND region IS NULL THEN 'none' WHEN style = 0 THEN 'none' WHEN style IN (2, 6) THEN 'none'
 WHEN style = 1 THEN CASE WHEN printed THEN 'consensus' ELSE 'unsupported' END WHEN style = 3 THEN CASE WHEN region = code THEN 'consensus' ELSE 'conflict' END WHEN style = 4 THEN CASE WHEN printed THEN 'direct' ELSE 'unsupported' END ELSE 'none' END AS status FROM z)
SELECT doc_id, row_no, CASE WHEN status IN ('kept', 'direct', 'consensus') THEN code ELSE '' END AS sku, status FROM y""")
def targeted_recovery(spark, d):
    """Codes for all order lines: their own, their model, their region's only one with readings that agree, or none. Readings: style 1 two that agree, style 3 two for it and two for another code, style 4 a cell, style 5 one alone."""
    rows = _region_rows(spark, d)
    found = cut(regions.best_regions(rows, _source_lines(spark, d), "sku").select("doc_id", "row_no", "text"), "regions", "doc_id")
    read = lambda value, lane, source: F.struct(value.alias("value"), F.lit(lane).alias("lane"), F.lit(source).alias("source"))
    style, code, other = F.col("style"), F.col("code"), F.concat(F.col("code"), F.lit("Z"))
    said = (
        F.when(style == 1, F.array(read(code, "reading", "x"), read(code, "reading", "y"))).when(style == 3, F.array(read(code, "reading", "x"), read(code, "reading", "y"), read(other, "reading", "u"), read(other, "reading", "v")))
        .when(style == 4, F.array(read(code, "cell", "layout"))).when(style == 5, F.array(read(code, "reading", "x")))
    )
    evidence = rows.select("doc_id", "row_no", F.explode(said).alias("x")).select("doc_id", "row_no", "x.*")
    return regions.recover_codes(rows, found, evidence).select("doc_id", "row_no", "sku", "status")
