"""Registered queries about verification: rows printed as documents, read as text, judged and compared."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.economics import econ_ok
from ..operators import authority, matching, parsers
from ..operators import verification as v
from ..sources.cut import cut
from ..sources.views import table
from .documents import LINES_SQL, _lines
from .queries import query

TITLE, HEADING = "TAX INVOICE", "Description Qty Unit Price Amount"
#: What a row names, by part; {} is the name of the part.
NAMES = ("{} projector", "Installation of {}", "{} cable", "{} extended warranty", "Blk 12 Example Road", "15/12/2023", "supplier", "number", "{}", "{} microphone stand", "{}", "{} document camera")


def _name_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN " + ("supplier" if n == "supplier" else "number" if n == "number" else "'" + n.replace("{}", "' || p_name || '") + "'") for i, n in enumerate(NAMES))
    return f"CASE l_partkey % {len(NAMES)} {cases} END"


def _has(text: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({text}, '(?i){quoted}')"


ROWS_SQL = f"""{LINES_SQL}, h AS (SELECT *, 'Acme Trading ' || CAST(doc_id % 97 AS VARCHAR) AS supplier, 'INV-' || CAST(doc_id AS VARCHAR) AS number FROM li),
r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, l_partkey, q, a) AS INT) AS row_no, supplier, number, l_partkey, l_suppkey, l_returnflag,
 CASE WHEN l_partkey % 12 IN (5, 6, 7, 10) THEN '' ELSE 'MX' || CAST(l_partkey AS VARCHAR) END AS sku, {_name_sql()} AS name, CAST(q AS DOUBLE) AS q, p, CAST(a AS DOUBLE) + CASE WHEN l_suppkey % 5 = 0 THEN 10 ELSE 0 END AS a, l_suppkey % 7 <> 0 AS shown FROM h),
t AS (SELECT *, trim(sku || ' ' || name) AS text, abs(q * p - a) <= greatest(0.06::DOUBLE, abs(a) * 0.005::DOUBLE) AS econ, abs(q * p - a) <= greatest(0.03::DOUBLE, abs(a) * 0.003::DOUBLE) AS tight FROM r)"""

BARE = "regexp_replace(upper({}), '[^A-Z0-9]+', '', 'g')"
REASON_SQL = f"""CASE WHEN text = '' THEN 'empty-row' WHEN name = supplier OR ({BARE.format("text")} LIKE '%' || {BARE.format("supplier")} || '%' AND NOT {_has("text", v.EQUIPMENT)}) THEN 'document-supplier'
 WHEN length({BARE.format("number")}) >= 4 AND name = number THEN 'document-invoice-number' WHEN {_has("text", v.HEADER_WORDS)} THEN 'header-or-contact-metadata'
 WHEN {_has("text", v.COMPANY)} AND NOT {_has("text", v.EQUIPMENT)} THEN 'company-header' WHEN {_has("text", v.ADDRESS)} OR {_has("name", v.ADDRESS)} THEN 'address-metadata'
 WHEN {_has("text", v.DATE_LABEL)} OR {_has("name", v.DATE_VALUE)} OR {_has("sku", v.DATE_VALUE)} THEN 'date-metadata'
 WHEN {_has("text", v.WARRANTY)} AND (NOT {_has("name", v.EQUIPMENT)} OR {_has("name", v.WARRANTY_START)}) THEN 'warranty-or-support'
 WHEN {_has("sku", v.SERVICE_SKU)} OR {_has("name", v.SERVICE_START)} OR (NOT ({_has("name", v.SUPPLIED)} AND {_has("name", v.EQUIPMENT)} AND NOT {_has("name", v.ACCESSORY)}) AND {_has("name", v.SERVICE_ACTION)})
 OR ({_has("text", v.SERVICE)} AND NOT {_has("text", v.EQUIPMENT)}) THEN 'service-or-labour'
 WHEN {_has("text", v.ACCESSORY)} AND NOT {_has("text", v.MICROPHONE_STAND)} AND NOT {_has("text", v.EQUIPMENT)} THEN 'excluded-accessory' END"""
SMALL_SQL = ", ".join(f"'{w}'" for w in v.SMALL_WORDS)
#: Every row against every line of its document: brute force, where the query joins on words.
PROOF_SQL = f"""pl AS (SELECT doc_id, row_no + 1 AS n, trim(sku || ' ' || name || ' ' || CAST(CAST(q AS INT) AS VARCHAR) || ' ' || CAST(CAST(p AS DECIMAL(14,2)) AS VARCHAR) || ' ' || CAST(CAST(a AS DECIMAL(14,2)) AS VARCHAR)) AS line FROM t WHERE shown
 UNION ALL SELECT DISTINCT doc_id, 0, '{TITLE}' FROM t UNION ALL SELECT DISTINCT doc_id, 1, '{HEADING}' FROM t),
ctx AS (SELECT doc_id, line, CAST(row_number() OVER o - 1 AS INT) AS line_no, concat_ws(' ', lag(line, 1) OVER o, line, lead(line, 1) OVER o, lead(line, 2) OVER o) AS near FROM pl WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
k AS (SELECT *, string_split(trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM ctx),
w AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3 AND x NOT IN ({SMALL_SQL}))) AS toks FROM t),
proof AS (SELECT w.doc_id, w.row_no, min(k.line_no) AS line_no FROM w JOIN k ON k.doc_id = w.doc_id
 WHERE ((length(w.sku) >= 3 AND list_contains(k.words, lower(w.sku))) OR (len(w.toks) > 0 AND len(list_intersect(w.toks, k.words)) >= least(2, len(w.toks))))
 AND len(regexp_extract_all(k.near, '{v.PRICE}')) >= 2 AND list_contains(string_split(k.near, ' '), CAST(CAST(w.q AS INT) AS VARCHAR)) GROUP BY 1, 2),
j AS (SELECT t.*, proof.line_no, proof.line_no IS NOT NULL AS proven, {REASON_SQL} AS refused, {_has("text", v.EQUIPMENT)} AS equipment, {_has("sku", v.MODEL)} AND {_has("sku", "[0-9]")} AS model FROM t LEFT JOIN proof USING (doc_id, row_no)),
g AS (SELECT *, CASE WHEN refused IS NOT NULL THEN 'reject' WHEN NOT proven OR NOT econ THEN CASE WHEN equipment OR model THEN 'review' ELSE 'reject' END WHEN equipment THEN 'verified' WHEN model THEN 'candidate' ELSE 'review' END AS status,
 CASE WHEN refused IS NOT NULL THEN refused WHEN NOT proven THEN CASE WHEN equipment OR model THEN 'source-row-not-proven' ELSE 'not-proven-as-line-item' END WHEN NOT econ THEN CASE WHEN equipment OR model THEN 'line-item-economics-unverified' ELSE 'unverified-economics' END
 WHEN equipment THEN 'physical-equipment-description' WHEN model THEN 'model-and-priced-row-proven' ELSE 'physical-equipment-identity-unproven' END AS reason FROM j)"""
WORDS_SQL = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
KIND_SQL = f"""CASE WHEN {WORDS_SQL} = '' THEN 'unknown' {" ".join(f"WHEN regexp_matches({WORDS_SQL}, '{p}')" + (f" AND NOT regexp_matches({WORDS_SQL}, '" + chr(92) + "bmicrophone stand" + chr(92) + "b')" if n == "accessory" else "") + f" THEN '{n}'" for n, p in v.DISPOSITIONS)}
 WHEN (regexp_matches({WORDS_SQL}, '{v.ASSET}') OR sku <> '') AND tight THEN 'equipment' ELSE 'unknown' END"""


def _rows(spark, d):
    """Order lines as rows read from documents, with the header of their document. One in five adds up wrongly, one in seven is not printed."""
    li = _lines(spark, d).withColumns({"supplier": F.concat(F.lit("Acme Trading "), (F.col("doc_id") % 97).cast("string")), "number": F.concat(F.lit("INV-"), F.col("doc_id").cast("string"))})
    k = F.col("l_partkey") % len(NAMES)
    name = F.lit(None).cast("string")
    for i, n in enumerate(NAMES):
        name = F.when(k == i, F.col(n) if n in ("supplier", "number") else F.replace(F.lit(n), F.lit("{}"), F.col("p_name"))).otherwise(name)
    w = Window.partitionBy("doc_id").orderBy("ord", "l_partkey", "q", "a")
    return li.select(
        "doc_id", F.row_number().over(w).alias("row_no"), "supplier", "number", "l_partkey", "l_suppkey", "l_returnflag", F.when(k.isin(5, 6, 7, 10), "").otherwise(F.concat(F.lit("MX"), F.col("l_partkey").cast("string"))).alias("sku"),
        name.alias("item_name"), F.col("q").cast("double").alias("quantity"), F.col("p").alias("unit_price"), (F.col("a").cast("double") + F.when(F.col("l_suppkey") % 5 == 0, 10).otherwise(0)).alias("amount"), (F.col("l_suppkey") % 7 != 0).alias("shown"),
    )


def _texts(rows):
    cash = lambda c: F.col(c).cast("decimal(14,2)").cast("string")
    line = F.trim(F.concat_ws(" ", "sku", "item_name", F.col("quantity").cast("int").cast("string"), cash("unit_price"), cash("amount")))
    each = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("row_no", line.alias("line"))))).alias("x"))
    body = F.concat(F.array(F.lit(TITLE), F.lit(HEADING)), F.transform("x", lambda x: x.line))
    return each.select("doc_id", F.array_join(body, "\n").alias("text"))


def _proven(spark, d):
    rows = _rows(spark, d)
    proof = v.proven_rows(rows, parsers.lines_of(_texts(rows))).select("doc_id", "row_no", "line_no")
    return rows.join(proof, ["doc_id", "row_no"], "left").withColumn("proven", F.col("line_no").isNotNull())


HEADER = {"supplier": "supplier", "invoice-number": "number"}


def _gated(spark, d):
    c = F.col
    rows = v.judged(_proven(spark, d), HEADER).withColumn("economics", econ_ok(c("quantity"), c("unit_price"), c("amount"), "gate"))
    return rows.withColumn("gate", v.row_gate(c("refused"), c("equipment"), c("model_like"), c("proven"), c("economics")))


def _disposed(spark, d):
    c = F.col
    return _rows(spark, d).withColumn("disposition", v.disposition(c("sku"), c("item_name"), c("quantity"), c("unit_price"), c("amount")))


@query(f"WITH {ROWS_SQL} SELECT doc_id, row_no, {REASON_SQL} AS reason FROM t")
def non_equipment_reasons(spark, d):
    return v.judged(_rows(spark, d), HEADER).select("doc_id", "row_no", F.col("refused").alias("reason"))


@query(f"WITH {ROWS_SQL} SELECT doc_id, row_no, {KIND_SQL} AS disposition FROM t")
def row_dispositions(spark, d):
    return _disposed(spark, d).select("doc_id", "row_no", "disposition")


@query(f"""WITH {ROWS_SQL}, k AS (SELECT doc_id, {KIND_SQL} AS d FROM t) SELECT doc_id, count(*) AS detected, count(*) FILTER (d = 'equipment') AS equipment, count(*) FILTER (d = 'service') AS service,
 count(*) FILTER (d = 'accessory') AS accessory, count(*) FILTER (d = 'warranty') AS warranty, count(*) FILTER (d = 'metadata') AS metadata, count(*) FILTER (d = 'unknown') AS "unknown",
 count(*) FILTER (d <> 'unknown') AS accounted, count(*) FILTER (d = 'unknown') = 0 AS complete FROM k GROUP BY 1""")
def ledger_summary(spark, d):
    return v.ledger_summary(_disposed(spark, d))


@query(f"WITH {ROWS_SQL}, {PROOF_SQL} SELECT doc_id, row_no, proven, line_no, status, reason FROM g")
def source_proof_gate(spark, d):
    """Each row against the text of its document: proven or not, in which line, and what the gate says of the row alone."""
    return _gated(spark, d).select("doc_id", "row_no", "proven", "line_no", "gate.status", "gate.reason")


@query(f"""WITH {ROWS_SQL}, {PROOF_SQL}, m AS (SELECT g.*, p_partkey IS NOT NULL AS known, CASE l_suppkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'unconfirmed' END AS web FROM g LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON sku = 'MX' || CAST(p_partkey AS VARCHAR)),
b AS (SELECT *, CASE WHEN status = 'reject' THEN 'rejected' WHEN coalesce(web = 'confirmed', FALSE) AND proven AND econ THEN 'verified' ELSE 'pending' END AS bucket FROM m)
SELECT doc_id, row_no, bucket, CASE bucket WHEN 'rejected' THEN reason WHEN 'verified' THEN 'web-confirmed' ELSE CASE WHEN web IS NULL THEN 'mandatory-web-unavailable' WHEN web = 'confirmed' THEN 'invoice-item-evidence-unproven' ELSE 'mandatory-web-unconfirmed' END END AS reason, bucket = 'verified' AND known AS canonical FROM b""")
def full_gate(spark, d):
    """Gate, master item with the same code and web evidence of each row, as one verdict."""
    known = table(spark, d, "part").where("p_size <= 25").select(F.concat(F.lit("MX"), F.col("p_partkey").cast("string")).alias("sku"), F.lit("confirmed").alias("match"))
    web = F.when(F.col("l_suppkey") % 3 == 0, "confirmed").when(F.col("l_suppkey") % 3 == 1, "unconfirmed")
    r = _gated(spark, d).join(known, "sku", "left")
    verdict = v.full_gate(F.col("gate"), F.col("proven"), F.col("economics"), F.col("match"), web)
    return r.select("doc_id", "row_no", verdict.alias("v")).select("doc_id", "row_no", "v.*")


@query(f"""WITH {ROWS_SQL}, k AS (SELECT doc_id, row_no, shown, {KIND_SQL} AS d FROM t), s AS (SELECT doc_id, count(*) FILTER (d = 'unknown') AS u, count(*) FILTER (d = 'equipment' AND NOT shown) AS lost FROM k GROUP BY 1)
SELECT o_orderkey AS doc_id, concat_ws(',', CASE WHEN coalesce(u, 0) > 0 THEN 'unaccounted-source-rows' END, CASE WHEN coalesce(lost, 0) > 0 THEN 'final-items-incomplete' END, CASE WHEN o_orderkey % 11 = 0 THEN 'supplier-not-proven' END,
 CASE WHEN o_orderkey % 13 = 0 THEN 'invoice-number-not-proven' END, CASE WHEN o_orderdate IS NULL THEN 'invoice-date-not-proven' END) AS issues,
 coalesce(u, 0) = 0 AND coalesce(lost, 0) = 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderdate IS NOT NULL AS safe_to_promote FROM orders LEFT JOIN s ON doc_id = o_orderkey""")
def analysis_gate(spark, d):
    """Issues of every order as a document: rows without a disposition, equipment that was not printed, headers not proven."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    headers = o.select(key.alias("doc_id"), F.when(key % 11 == 0, " ").otherwise("Acme Trading").alias("supplier_name"), F.when(key % 13 != 0, F.concat(F.lit("INV-"), key.cast("string"))).alias("invoice_number"), F.col("o_orderdate").alias("invoice_date"))
    rows = _disposed(spark, d)
    got = v.analysis_gate(headers, v.ledger_summary(rows), rows.where("disposition = 'equipment' AND NOT shown"))
    return got.select("doc_id", F.array_join("issues", ",").alias("issues"), "safe_to_promote")


BARE_SN = "upper(trim({}))"
#: Two readings of the rows; the second lacks a quarter of them, has them in reverse and differs in some fields. Each row is scored with each row of the other
#: reading of its document; the recursion goes from row to row and keeps what is taken.
PAIRS_SQL = f"""{ROWS_SQL}, x AS (SELECT doc_id, row_no AS no, sku, name, l_partkey, shown, q, CAST(p AS DOUBLE) AS p, a, 'SN' || CAST(l_suppkey AS VARCHAR) AS sn FROM t),
y AS (SELECT doc_id, 100 - row_no AS no, CASE WHEN l_partkey % 10 = 3 OR sku = '' THEN '' ELSE replace(sku, 'MX', 'mx-') || CASE WHEN l_partkey % 10 = 4 THEN 'Z' ELSE '' END END AS sku, name, q + CASE WHEN l_partkey % 6 = 0 THEN 1 ELSE 0 END AS q, CASE WHEN l_partkey % 9 <> 4 THEN CAST(p AS DOUBLE) END AS p,
 a + CASE l_partkey % 8 WHEN 1 THEN 1 WHEN 2 THEN 0.01::DOUBLE ELSE 0 END AS a, 'sn' || CAST(l_suppkey AS VARCHAR) || CASE WHEN l_partkey % 5 = 2 THEN 'X' ELSE '' END AS sn FROM t WHERE l_suppkey % 4 <> 0),
tx AS (SELECT *, {BARE.format("sku")} AS k, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda z: length(z) >= 3)) AS w, regexp_replace({BARE.format("sku")}, '[A-Z]$', '') AS stem FROM x),
ty AS (SELECT *, {BARE.format("sku")} AS k, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda z: length(z) >= 3)) AS w, regexp_replace({BARE.format("sku")}, '[A-Z]$', '') AS stem FROM y),
sc AS (SELECT tx.doc_id, tx.no AS p, ty.no AS s, CAST(CASE WHEN tx.k = '' OR ty.k = '' THEN 0 WHEN tx.k = ty.k THEN 8
 WHEN length(tx.stem) >= 5 AND (tx.stem = ty.k OR ty.stem = tx.k OR tx.stem = ty.stem) THEN 5 ELSE 0 END AS DOUBLE)
 + CASE WHEN len(tx.w) = 0 AND len(ty.w) = 0 THEN 1::DOUBLE WHEN len(tx.w) = 0 OR len(ty.w) = 0 THEN 0::DOUBLE ELSE len(list_intersect(tx.w, ty.w)) / greatest(len(tx.w), len(ty.w)) END * 5::DOUBLE
 + (CASE WHEN abs(tx.q - ty.q) < 0.02::DOUBLE THEN 6 ELSE -8 END + CASE WHEN ty.p IS NULL THEN 0 WHEN abs(tx.p - ty.p) < 0.02::DOUBLE THEN 3 ELSE -3 END + CASE WHEN abs(tx.a - ty.a) < 0.02::DOUBLE THEN 5 ELSE -5 END)
 + CASE WHEN {BARE_SN.format("tx.sn")} = {BARE_SN.format("ty.sn")} THEN 6 ELSE 0 END AS score FROM tx JOIN ty USING (doc_id)),
good AS (SELECT * FROM sc WHERE score >= 6), n AS (SELECT doc_id, max(no) AS n FROM x GROUP BY 1),
go AS (SELECT doc_id, n, 0 AS p, CAST(NULL AS STRUCT(m DOUBLE, s INT)) AS b, CAST([] AS INT[]) AS used FROM n
 UNION ALL SELECT doc_id, n, p, b, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.s) END FROM (SELECT go.doc_id, go.n, go.p + 1 AS p, go.used,
  min(CASE WHEN good.s IS NOT NULL THEN struct_pack(m := -good.score, s := CAST(good.s AS INT)) END) AS b FROM go LEFT JOIN good ON good.doc_id = go.doc_id AND good.p = go.p + 1 AND NOT list_contains(go.used, CAST(good.s AS INT)) WHERE go.p < go.n GROUP BY 1, 2, 3, 4)),
won AS (SELECT doc_id, CAST(p AS INT) AS no, b.s AS second_no, -b.m AS score FROM go WHERE p > 0)"""


def _two_readings(spark, d):
    """Every row, and a second reading that lacks a quarter of the rows, has them in reverse and differs in some fields."""
    c, k = F.col, F.col("l_partkey")
    serial = F.concat(F.lit("SN"), c("l_suppkey").cast("string"))
    rows = _rows(spark, d)
    first = rows.select("doc_id", c("row_no").alias("no"), "sku", "item_name", "quantity", "unit_price", "amount", F.array(serial).alias("serials"), "shown", "l_partkey")
    second = rows.where("l_suppkey % 4 <> 0").select(
        "doc_id", (100 - c("row_no")).alias("no"), F.when((k % 10 == 3) | (c("sku") == ""), "").otherwise(F.concat(F.replace("sku", F.lit("MX"), F.lit("mx-")), F.when(k % 10 == 4, "Z").otherwise(""))).alias("sku"), "item_name", (c("quantity") + F.when(k % 6 == 0, 1).otherwise(0)).alias("quantity"),
        F.when(k % 9 != 4, c("unit_price")).alias("unit_price"), (c("amount") + F.when(k % 8 == 1, 1.0).when(k % 8 == 2, 0.01).otherwise(0.0)).alias("amount"),
        F.when(k % 5 == 2, F.array(F.concat(F.lower(serial), F.lit("X")))).otherwise(F.array(F.lower(serial))).alias("serials"),
    )
    return first, second


@query(f"""WITH RECURSIVE {PAIRS_SQL} SELECT doc_id, no, second_no, round(score, 6) AS score, CASE WHEN second_no IS NULL THEN 'missing' ELSE 'matched' END AS status FROM won
UNION ALL SELECT doc_id, NULL, CAST(no AS INT), NULL, 'unexpected' FROM y WHERE NOT EXISTS (SELECT 1 FROM won WHERE won.doc_id = y.doc_id AND won.second_no = y.no)""")
def reading_pairs(spark, d):
    """The rows of two readings of every document, one to one."""
    return matching.pair_readings(*_two_readings(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {PAIRS_SQL}, s AS (SELECT x.*, won.second_no IS NOT NULL AS m, y.sku AS sku2, y.q AS q2, y.p AS p2, y.a AS a2, y.sn AS sn2 FROM x JOIN won USING (doc_id, no) LEFT JOIN y ON y.doc_id = x.doc_id AND y.no = won.second_no),
f AS (SELECT *, m AND {BARE.format("sku")} <> {BARE.format("sku2")} AS d1, m AND abs(q - q2) >= 0.02::DOUBLE AS d2, m AND (p2 IS NULL OR abs(p - p2) >= 0.02::DOUBLE) AS d3, m AND abs(a - a2) >= 0.02::DOUBLE AS d4, m AND upper(sn) <> upper(sn2) AS d5,
 shown AND l_partkey % 4 <> 0 AS paid FROM s)
SELECT doc_id, no AS row_no, concat_ws(',', CASE WHEN d1 THEN 'sku' END, CASE WHEN d2 THEN 'quantity' END, CASE WHEN d3 THEN 'unit_price' END, CASE WHEN d4 THEN 'amount' END, CASE WHEN d5 THEN 'serials' END) AS disagreements,
 CASE WHEN NOT m THEN 'unavailable' WHEN d1 OR d2 OR d3 OR d4 OR d5 THEN 'disagree' ELSE 'confirmed' END AS layer_two, NOT m OR d1 OR d2 OR d3 OR d4 OR d5 AS human_review, m AND NOT d2 AS core_verified,
 CASE WHEN sku = '' OR d1 THEN 'not_found' WHEN shown OR m THEN 'confirmed' ELSE 'uncertain' END AS sku_state, CASE WHEN shown OR m THEN 'confirmed' ELSE 'uncertain' END AS name_state,
 CASE WHEN paid OR (m AND NOT d2) THEN 'confirmed' ELSE 'uncertain' END AS quantity_state, CASE WHEN d4 THEN 'not_found' WHEN paid OR m THEN 'confirmed' ELSE 'uncertain' END AS amount_state,
 CASE WHEN d1 AND {BARE.format("sku")} <> '' AND sku2 <> '' THEN sku || '|' || sku2 END AS sku_choices, CASE WHEN d5 THEN sn || '|' || sn2 END AS serial_choices FROM f""")
def three_layer_verification(spark, d):
    """Every row beside what pair_readings finds for it in a second reading; the money of a quarter of the printed rows stands elsewhere."""
    first, second = _two_readings(spark, d)
    got = v.independent_readings(first, second).join(first.select("doc_id", "no", "shown", (F.col("shown") & (F.col("l_partkey") % 4 != 0)).alias("paid")), ["doc_id", "no"])
    shown, paid = F.col("shown"), F.col("paid")
    got = v.three_layers(v.compare_readings(got), {"sku": shown, "item_name": shown, "serials": shown, "quantity": paid, "unit_price": paid, "amount": paid})
    states = [F.col(f"evidence.{f}").alias(n) for f, n in (("sku", "sku_state"), ("item_name", "name_state"), ("quantity", "quantity_state"), ("amount", "amount_state"))]
    pick = [F.array_join(F.col(f"choices.{f}"), "|").alias(n) for f, n in (("sku", "sku_choices"), ("serials", "serial_choices"))]
    return got.select("doc_id", F.col("no").alias("row_no"), F.array_join("disagreements", ",").alias("disagreements"), "layer_two", "human_review", "core_verified", *states, *pick)


@query(f"""WITH {ROWS_SQL}, {PROOF_SQL}, f AS (SELECT * FROM j WHERE l_suppkey % 4 <> 0), e AS (SELECT doc_id, count(DISTINCT row_no) AS n FROM j WHERE shown AND (equipment OR model) GROUP BY 1), hd AS (SELECT doc_id, count(*) AS held FROM f GROUP BY 1)
SELECT doc_id, row_no, 'conflict' AS kind, 'refused:' || refused AS reason FROM f WHERE refused IS NOT NULL AND l_suppkey % 4 <> 1
UNION ALL SELECT doc_id, row_no, 'warning', 'code-not-in-document' FROM f WHERE refused IS NULL AND length(sku) >= 3 AND l_suppkey % 4 <> 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = f.doc_id AND list_contains(k.words, lower(f.sku)))
UNION ALL SELECT e.doc_id, NULL, 'warning', 'numbered-rows-missing' FROM e LEFT JOIN hd ON hd.doc_id = e.doc_id WHERE n > coalesce(held, 0)""")
def countercheck(spark, d):
    """Three quarters of the rows as read, a third of these pending, against the printed lines and the numbers of all of them."""
    plain = _rows(spark, d)
    rows = cut(v.judged(plain, HEADER).select("doc_id", "row_no", "sku", "shown", "l_suppkey", "refused", "equipment", "model_like"), "rows")
    anchors = rows.where("shown").select("doc_id", F.col("row_no").alias("ordinal"), (F.col("equipment") | F.col("model_like")).alias("strong"))
    read = rows.where("l_suppkey % 4 <> 0").withColumn("status", F.when(F.col("l_suppkey") % 4 == 1, "pending").otherwise("read"))
    return v.countercheck(read, parsers.lines_of(_texts(plain)), anchors)


TITLES = ("TAX INVOICE\nInvoice No: INV-1", "Page 2 of 3\ncontinued", "Purchase Order No 4711", "Delivery Note", "Purchase Order No: 4711\nDescription Qty\nUnit Price Amount\nTotal 5.00", "Bill of Quantities", "Serial list")
TITLE_SQL = "CASE {} END".format(" ".join(f"WHEN k = {i} THEN '" + t.replace("\n", "' || chr(10) || '") + "'" for i, t in enumerate(TITLES)))


@query(f"""WITH r AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS page, (l_partkey + l_suppkey) % {len(TITLES)} AS k, l_partkey FROM lineitem),
x AS (SELECT doc_id, page, {TITLE_SQL} || chr(10) || 'Part ' || CAST(l_partkey AS VARCHAR) AS text FROM r),
y AS (SELECT *, len(list_filter(string_split(text, chr(10)), lambda z: regexp_matches(trim(regexp_replace(upper(z), '[^A-Z0-9/#&().: -]+', ' ', 'g')), '{authority.PROHIBITED_TITLES}'))) > 0 AS bad,
 len(list_filter(string_split(text, chr(10)), lambda z: regexp_matches(lower(z), '^(tax )?invoice\\b'))) > 0 OR (regexp_matches(lower(text), '\\b(qty|quantity)\\b') AND regexp_matches(lower(text), '\\b(unit price|amount)\\b') AND regexp_matches(lower(text), '\\btotal\\b')) AS good FROM x),
m AS (SELECT doc_id, page, CASE WHEN bad THEN 'reject' WHEN good THEN 'accept' END AS mark FROM y), s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) AS state FROM m)
SELECT doc_id, page, mark, state, coalesce(state = 'accept', FALSE) AS allowed FROM s""")
def page_text_authority(spark, d):
    """Pages as text, one for each order line: marks of their titles, and what pages without a mark inherit."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    k = (F.col("l_partkey") + F.col("l_suppkey")) % len(TITLES)
    title = F.element_at(F.array(*map(F.lit, TITLES)), (k + 1).cast("int"))
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("page"), F.concat(title, F.lit("\nPart "), F.col("l_partkey").cast("string")).alias("text"))
    return authority.page_authority(pages.withColumn("mark", authority.page_marks("text")), "doc_id", "page", "mark").select("doc_id", "page", "mark", "state", "allowed")
