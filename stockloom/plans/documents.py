"""Registered queries about documents: printed, read back, weighed, saved and deleted. Their texts are rendered from the
supplied tables, so what stands in them is known and the SQL beside each query can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.economics import half_up_2
from ..operators import evidence, parsers
from ..sources import sinks
from ..sources.cut import spread
from ..sources.views import table
from .queries import query

LINES_SQL = """li AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_suppkey AS ord, l_partkey, l_suppkey, l_returnflag, CAST(l_quantity AS INT) AS q, CAST(l_extendedprice AS DECIMAL(14,2)) AS a,
 floor(l_extendedprice / l_quantity * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS p, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _lines(spark, d):
    """Order lines with the names of their parts; those of an order lie together. They travel as they were read, so that what is made of them is neither shuffled nor keeps two uses of them apart."""
    raw = table(spark, d, "lineitem")
    li = raw.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    li = spread(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "p_name"), raw, "l_orderkey")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("ord"), "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("int").alias("q"),
        F.col("l_extendedprice").cast("decimal(14,2)").alias("a"), half_up_2(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), "p_name",
    )


def _texts(spark, d):
    """Each order as the text of an invoice: a header, a line per item with its serial below, a total, and small print."""
    cash = lambda c: F.format_number(F.col(c).cast("double"), 2)
    row = F.concat_ws(" ", F.concat(F.lit("MX"), F.col("l_partkey").cast("string")), "p_name", F.col("q").cast("string"), cash("p"), cash("a"))
    both = F.concat(row, F.lit("\nS/N: SN"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    g = _lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "a", both.alias("r")))).alias("x"))
    text = F.concat(F.lit("Tax Invoice\nDescription  Qty  Unit Price  Amount\n"), F.array_join(F.transform("x", lambda x: x.r), "\n"), F.lit("\nSub Total 1.00 2.00\nGoods stay ours 7 1.00 7.00"))
    return g.select("doc_id", text.alias("text"))


@query(f"WITH {LINES_SQL} SELECT doc_id, 'MX' || CAST(l_partkey AS VARCHAR) AS sku, p_name AS item_name, CAST(q AS DOUBLE) AS quantity, p AS unit_price, CAST(a AS DOUBLE) AS amount, 'SN' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS serial FROM li")
def parse_invoice_pages(spark, d):
    rows = parsers.parse_pages(_texts(spark, d))
    return rows.select("doc_id", "sku", "item_name", "quantity", "unit_price", "amount", F.array_join("serials", ",").alias("serial"))


@query(f"""WITH {LINES_SQL}, f AS (SELECT doc_id, l_partkey, min(k) AS k FROM (SELECT doc_id, l_partkey, row_number() OVER (PARTITION BY doc_id ORDER BY ord, a) AS k FROM li) GROUP BY 1, 2)
SELECT doc_id, 'MX' || CAST(l_partkey AS VARCHAR) AS value, CAST(2 * k AS INT) AS line_no FROM f""")
def evidence_line_lookup(spark, d):
    """The first line that names a code, for all codes of all orders; short codes too, as words are compared whole."""
    codes = _lines(spark, d).select("doc_id", F.lit("sku").alias("field"), F.concat(F.lit("MX"), F.col("l_partkey").cast("string")).alias("value")).distinct()
    return evidence_lines(codes, parsers.lines_of(_texts(spark, d)))


def evidence_lines(values, lines):
    return parsers.evidence_lines(values, lines).select("doc_id", "value", "line_no")


@query(f"""WITH {LINES_SQL}, r AS (SELECT doc_id, ord, a, q, 'S' || CAST(l_suppkey % 20 AS VARCHAR) AS s, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, a, q) AS INT) AS row_no FROM li)
SELECT doc_id, row_no, count(*) OVER (PARTITION BY doc_id, s) > 1 AS serial_conflict, q < 2 AS too_many_serials FROM r""")
def serial_integrity(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("ord", "a", "q")
    r = _lines(spark, d).withColumn("row_no", F.row_number().over(w))
    s = F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string"))
    r = r.select("doc_id", "row_no", F.col("q").alias("quantity"), F.array(s, F.concat(F.lit("X"), F.col("doc_id").cast("string"), F.lit("-"), F.col("row_no").cast("string"))).alias("serials"))
    return parsers.serial_conflicts(r).select("doc_id", "row_no", "serial_conflict", "too_many_serials")


@query(f"""WITH {LINES_SQL}, c AS (SELECT doc_id, l_partkey % 4 AS item, l_returnflag AS source, l_suppkey % 5 = 0 AS strict, CAST(q AS DOUBLE) AS q, p, CAST(a AS DOUBLE) AS a, CAST(CAST(q AS DECIMAL(18,2)) AS VARCHAR) || '|' || CAST(CAST(p AS DECIMAL(18,2)) AS VARCHAR) || '|' || CAST(CAST(a AS DECIMAL(18,2)) AS VARCHAR) AS sig FROM li
 WHERE abs(q * p - CAST(a AS DOUBLE)) <= greatest(0.03::DOUBLE, abs(CAST(a AS DOUBLE)) * 0.002::DOUBLE)),
g AS (SELECT doc_id, item, sig, count(DISTINCT source) AS sources, bool_or(strict) AS strict, min(q) AS q, min(p) AS p, min(a) AS a FROM c GROUP BY 1, 2, 3),
w AS (SELECT *, row_number() OVER o AS k, lead(sources) OVER o AS s2, lead(strict) OVER o AS t2 FROM g WINDOW o AS (PARTITION BY doc_id, item ORDER BY sources DESC, strict DESC, sig)),
z AS (SELECT *, CASE WHEN coalesce(strict AND t2 AND s2 >= sources, FALSE) THEN 'conflict' WHEN sources >= 2 OR strict THEN 'resolved' ELSE 'weak' END AS status FROM w WHERE k = 1)
SELECT doc_id, item, CASE WHEN status = 'resolved' THEN q END AS quantity, CASE WHEN status = 'resolved' THEN p END AS unit_price, CASE WHEN status = 'resolved' THEN a END AS amount, sources, status FROM z""")
def money_consensus(spark, d):
    c = _lines(spark, d).select("doc_id", (F.col("l_partkey") % 4).alias("item"), F.col("l_returnflag").alias("source"), (F.col("l_suppkey") % 5 == 0).alias("strict"), F.col("q").cast("double").alias("quantity"), F.col("p").alias("unit_price"), F.col("a").cast("double").alias("amount"))
    return evidence.money_consensus(c, ["doc_id", "item"])


@query(f"""WITH {LINES_SQL}, v AS (SELECT doc_id, 'MX' || CAST(l_partkey % 3 AS VARCHAR) AS model, l_returnflag AS source, l_suppkey % 2 = 0 AS explicit, q % 4 AS reliability FROM li),
g AS (SELECT doc_id, model, count(DISTINCT CASE WHEN explicit THEN source END) AS a, max(reliability) AS b, count(DISTINCT source) AS c FROM v GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY a DESC, b DESC, c DESC) AS k FROM g), t AS (SELECT doc_id, count(*) AS n, min(model) AS m FROM r WHERE k = 1 GROUP BY 1)
SELECT doc_id, CASE WHEN n = 1 THEN m END AS model, CASE WHEN n = 1 THEN 'resolved' ELSE 'tie' END AS status FROM t""")
def model_consensus_tie_blank(spark, d):
    v = _lines(spark, d).select("doc_id", F.concat(F.lit("MX"), (F.col("l_partkey") % 3).cast("string")).alias("model"), F.col("l_returnflag").alias("source"), (F.col("l_suppkey") % 2 == 0).alias("explicit"), (F.col("q") % 4).alias("reliability"))
    return evidence.rank_model_votes(v, ["doc_id"])


@query("""SELECT (l_quantity >= 1 AND l_partkey % 3 = 0) AS is_specification, count(*) AS n FROM lineitem GROUP BY 1""")
def quantity_specification_guard(spark, d):
    name = F.concat(F.lit("Lamp "), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.col("q").cast("string"), F.lit(" ansi lumens"))).otherwise(F.concat(F.lit("of "), F.col("q").cast("string"), F.lit(" parts"))))
    return _lines(spark, d).groupBy(parsers.quantity_is_specification(name, F.col("q")).alias("is_specification")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_orderdate < TIMESTAMP '1995-01-01' AS archived, 'INV-' || CAST(o_custkey AS VARCHAR) || CASE WHEN k > 1 THEN '-' || CAST(k AS VARCHAR) ELSE '' END || '.pdf' AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)""")
def vault_and_names(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("invoice_date"), F.concat(F.lit("INV-"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("name"))
    books, vault = sinks.split_vault(sinks.unique_names(o, "name", "o_orderkey"), 1995)
    return books.withColumn("archived", F.lit(False)).unionByName(vault.withColumn("archived", F.lit(True))).select("o_orderkey", "archived", "unique_name")


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), kept AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)),
lost AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM gone) AND l_partkey NOT IN (SELECT l_partkey FROM kept))
SELECT 'purchases' AS name, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'lines', count(*) FROM kept
UNION ALL SELECT 'masters', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lost) UNION ALL SELECT 'adjustments', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT l_partkey FROM lost)
UNION ALL SELECT 'serials', count(*) FROM kept""")
def delete_cascade(spark, d):
    """What is left of each table; each order line has a serial."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    after = sinks.delete_cascade(
        o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id")), o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("document_id")),
        li.select(line.alias("id"), F.col("l_orderkey").alias("purchase_id"), F.col("l_partkey").alias("master_item_id")),
        li.select(line.alias("purchase_item_id")), table(spark, d, "part").select(F.col("p_partkey").alias("id")), li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("master_item_id")),
    )
    parts = [after[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("purchases", "lines", "masters", "adjustments", "serials")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(f"""WITH {LINES_SQL}, known AS (SELECT DISTINCT p_partkey FROM part WHERE p_size <= 25)
SELECT CASE WHEN l_partkey IN (SELECT p_partkey FROM known) THEN CAST(l_partkey AS VARCHAR) ELSE 'new:sku:MX' || CAST(l_partkey AS VARCHAR) END AS item, count(*) AS n, CAST(sum(a) AS DECIMAL(24,2)) AS amount FROM li GROUP BY 1""")
def save_plan(spark, d):
    code = F.concat(F.lit("MX"), F.col("l_partkey").cast("string"))
    lines = _lines(spark, d).select("doc_id", F.col("ord").alias("line_no"), code.alias("sku"), F.lit("").alias("item_name"), F.col("q").alias("quantity"), F.col("p").alias("unit_price"), F.col("a").alias("amount"), F.array(F.lit("")).alias("serials"))
    masters = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"), F.concat(F.lit("mx-"), F.col("p_partkey").cast("string")).alias("sku"), F.col("p_name").alias("item_name"))
    plan = sinks.save_plan(masters, lines, lines)
    return plan["lines"].groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(24,2)").alias("amount"))


@query(f"""WITH {LINES_SQL}, r AS (SELECT doc_id, ord, '| ' || CAST(ord AS VARCHAR) || ' | ' || p_name || ' | ' || CAST(q AS VARCHAR) || ' | ' || CAST(CAST(p AS DECIMAL(14,2)) AS VARCHAR) || ' | ' || CAST(a AS VARCHAR) || ' |' AS t FROM li)
SELECT doc_id AS purchase_id, sha256('| # | Item | Qty | Unit | Amount |' || chr(10) || '|---|---|---|---|---|' || chr(10) || string_agg(t, chr(10) ORDER BY ord, t)) AS digest FROM r GROUP BY 1""")
def markdown_export(spark, d):
    rows = _lines(spark, d).select(F.col("doc_id").alias("purchase_id"), F.col("ord").alias("line_no"), F.col("p_name").alias("item_name"), F.col("q").alias("quantity"), F.col("p").cast("decimal(14,2)").alias("unit_price"), F.col("a").alias("amount"))
    return sinks.markdown_rows(rows).select("purchase_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("digest"))
