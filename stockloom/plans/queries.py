"""The registered queries: each builds one plan over the supplied tables; SQL beside it says the same for the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.economics import PROFILES, econ_ok, half_up_2
from ..functions.keys import compact, norm, normalized_item_identity, ocr_skeleton, standard_item_name_key, supplier_key
from ..functions.similarity import MEASURES, STOP_WORDS, similarity
from ..functions.text import model_tokens, money, money_tokens, parse_day_first
from ..operators import audit, authority, consensus, evidence, gates, health, ledger, matching, resolve, stock
from ..sources.cut import spread
from ..sources.views import adjustments, items, purchase_lines, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- stock ------------------------------------------------------------------------------------------------------

ITEMS_SQL = """items AS (SELECT p_partkey AS id, p_brand || '-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS item_name, p_brand AS brand,
  nullif(p_type, 'ECONOMY') AS category, p_retailprice AS list_price FROM part),
bought AS (SELECT l_partkey AS item_id, sum(CAST(l_quantity AS DECIMAL(14,2))) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
gone AS (SELECT l_partkey AS item_id, sum(CAST(l_quantity AS DECIMAL(14,2))) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
summary AS (SELECT items.*, CAST(coalesce(bought.q, 0) AS DECIMAL(24,2)) AS purchased, CAST(coalesce(gone.q, 0) AS DECIMAL(24,2)) AS adjusted,
  CAST(coalesce(bought.q, 0) - coalesce(gone.q, 0) AS DECIMAL(25,2)) AS current
  FROM items LEFT JOIN bought ON bought.item_id = id LEFT JOIN gone ON gone.item_id = id)"""


def _summary(spark, d):
    return stock.inventory_summary(items(spark, d), purchase_lines(spark, d), adjustments(spark, d))


@query(f"WITH {ITEMS_SQL} SELECT id, sku, item_name, purchased, adjusted, current FROM summary")
def inventory_summary(spark, d):
    return _summary(spark, d).select("id", "sku", "item_name", "purchased", "adjusted", "current")


@query(f"""WITH {ITEMS_SQL} SELECT count(*) AS n_items, CAST(sum(purchased) AS DECIMAL(34,2)) AS purchased, CAST(sum(current) AS DECIMAL(35,2)) AS current,
(SELECT count(*) FROM orders) AS n_documents FROM summary""")
def dashboard_totals(spark, d):
    return stock.dashboard_totals(_summary(spark, d), table(spark, d, "orders")).select("n_items", F.col("purchased").cast("decimal(34,2)"), F.col("current").cast("decimal(35,2)"), "n_documents")


@query(f"WITH {ITEMS_SQL} SELECT id, current FROM summary WHERE current < 0")
def negative_stock(spark, d):
    return _summary(spark, d).where("current < 0").select("id", "current")


def _partners(spark, d):
    lines = purchase_lines(spark, d)
    return stock.item_partners(lines, table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name")), "supplier_id", "name")


PARTNERS_SQL = """partners AS (SELECT l_partkey AS item_id, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS partners, count(DISTINCT s_name) AS n_partners
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'N' GROUP BY 1)"""


@query(f"WITH {PARTNERS_SQL} SELECT item_id, partners, n_partners FROM partners")
def item_suppliers(spark, d):
    return _partners(spark, d)


@query(f"""WITH {ITEMS_SQL}, {PARTNERS_SQL} SELECT coalesce(split_part(partners, '|', 1), 'Unknown') AS company, count(*) AS n_items, CAST(sum(current) AS DECIMAL(35,2)) AS current
FROM summary LEFT JOIN partners ON item_id = id GROUP BY 1""")
def supplier_grouped_inventory(spark, d):
    return stock.grouped_by_first_partner(_summary(spark, d), _partners(spark, d)).withColumn("current", F.col("current").cast("decimal(35,2)"))


@query(f"""WITH {ITEMS_SQL}, {PARTNERS_SQL} SELECT id, item_name, category FROM items LEFT JOIN partners ON item_id = id
WHERE trim(regexp_replace(lower(concat_ws(' ', item_name, sku, category, partners)), '[^a-z0-9]+', ' ', 'g')) LIKE '%supplier 000000007%' AND category = 'PROMO'""")
def inventory_search(spark, d):
    return stock.search(items(spark, d), _partners(spark, d), "Supplier#000000007", "PROMO").select("id", "item_name", "category")


@query(f"""WITH {ITEMS_SQL}, counted AS (SELECT l_partkey AS item_id, CAST(sum(CAST(l_quantity AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS physical FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT id, current, physical, CAST(physical - current AS DECIMAL(26,2)) AS difference,
CASE WHEN physical IS NULL THEN 'Not counted' WHEN physical = current THEN 'Match' WHEN physical < current THEN 'Short' ELSE 'Over' END AS status FROM summary LEFT JOIN counted ON item_id = id""")
def stock_take_differences(spark, d):
    a = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("item_id"))
    counted = a.agg(F.sum(F.col("l_quantity").cast("decimal(14,2)")).alias("physical"))
    return stock.stock_take(_summary(spark, d), counted).withColumns({"physical": F.col("physical").cast("decimal(24,2)"), "difference": F.col("difference").cast("decimal(26,2)")})


@query(f"""WITH {ITEMS_SQL}, wanted AS (SELECT l_partkey AS item_id, CAST(max(l_quantity) AS DECIMAL(14,2)) AS quantity FROM lineitem GROUP BY 1)
SELECT wanted.item_id, quantity, (quantity > 0 AND quantity <= coalesce(current, 0)) AS allowed FROM wanted LEFT JOIN summary ON id = item_id""")
def adjustment_check(spark, d):
    wanted = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.max("l_quantity").cast("decimal(14,2)").alias("quantity"))
    return stock.adjustment_allowed(_summary(spark, d), wanted).select("item_id", "quantity", "allowed")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_per_group(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return stock.latest_per_group(o, "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 500")
def topn_recent(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(500)


# --- health and integrity ---------------------------------------------------------------------------------------


def _serials(spark, d):
    """Order and supplier of a line stand for a serial: a supplier that delivers twice to an order makes a duplicate."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("serial"))


def _findings(spark, d):
    named = items(spark, d).select("id", F.concat_ws(" ", "brand", "item_name").alias("item_name"))
    return health.all_findings(
        _summary(spark, d), _serials(spark, d),
        table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("day")),
        table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("purchase_id")),
        resolve.linked_items(named, 0.72).where("first_id < id").select("id"),
    )


def _alike_sql(named: str) -> str:
    """Brute force: classes of equal words, all against all. named: a query of id and t."""
    words = f"list_sort(list_distinct(list_filter(string_split({NORM('t')}, ' '), lambda w: length(w) >= 2)))"
    return f"""own AS (SELECT id, {words} AS w FROM ({named})), cl AS (SELECT w, min(id) AS class_id, count(*) AS copies FROM own GROUP BY 1),
lk AS (SELECT a.class_id, sum(b.copies) AS others, min(b.class_id) AS low FROM cl a JOIN cl b ON a.class_id <> b.class_id AND len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w))::DOUBLE / greatest(len(a.w), len(b.w)) >= 0.72 GROUP BY 1),
alike AS (SELECT id, cl.class_id, CAST(CASE WHEN len(own.w) > 0 THEN copies - 1 ELSE 0 END + coalesce(others, 0) AS BIGINT) AS n_links, CASE WHEN len(own.w) > 0 THEN least(cl.class_id, coalesce(low, cl.class_id)) ELSE id END AS first_id
 FROM own JOIN cl ON cl.w = own.w LEFT JOIN lk ON lk.class_id = cl.class_id)"""


NORM = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"

FINDINGS_SQL = f"""{ITEMS_SQL}, {_alike_sql("SELECT p_partkey AS id, p_brand || ' ' || p_name AS t FROM part")},
serials AS (SELECT l_partkey AS item_id, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS serial FROM lineitem),
raw AS (
SELECT 'Missing category' AS issue_type, 'medium' AS severity, 'master_items' AS entity_type, CAST(id AS VARCHAR) AS entity_id FROM summary WHERE category IS NULL
UNION ALL SELECT 'Serial review', 'low', 'master_items', CAST(id AS VARCHAR) FROM summary WHERE purchased > 0 AND id NOT IN (SELECT item_id FROM serials)
UNION ALL SELECT 'Negative inventory', 'high', 'master_items', CAST(id AS VARCHAR) FROM summary WHERE current < 0
UNION ALL SELECT 'Missing invoice date', 'high', 'purchases', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P' OR o_orderdate IS NULL
UNION ALL SELECT 'Unlinked document', 'medium', 'documents', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'Possible duplicate', 'medium', 'master_items', CAST(id AS VARCHAR) FROM alike WHERE first_id < id
UNION ALL SELECT 'Duplicate serial', 'high', 'serial_numbers', lower(serial) FROM serials GROUP BY lower(serial) HAVING count(*) > 1),
findings AS (SELECT regexp_replace(lower(issue_type), '[^a-z0-9]+', '-', 'g') || ':' || entity_type || ':' || lower(entity_id) AS issue_key, severity, issue_type, entity_type, entity_id FROM raw)"""


@query(f"WITH {FINDINGS_SQL} SELECT * FROM findings")
def health_findings(spark, d):
    return _findings(spark, d)


@query(f"""WITH {FINDINGS_SQL}, s AS (SELECT CAST(100 - least(85, coalesce(sum(CASE severity WHEN 'high' THEN 12 WHEN 'medium' THEN 7 WHEN 'low' THEN 3 ELSE 5 END), 0)) AS BIGINT) AS score FROM findings)
SELECT score, CASE WHEN score >= 95 THEN 'Excellent' WHEN score >= 85 THEN 'Good' WHEN score >= 70 THEN 'Fair' ELSE 'Needs attention' END AS label FROM s""")
def health_score(spark, d):
    return health.score(_findings(spark, d))


@query(f"""WITH {FINDINGS_SQL} SELECT CASE WHEN issue_type = 'Missing category' THEN 'missing_category' WHEN issue_type IN ('Serial review', 'Duplicate serial') THEN 'serial'
WHEN issue_type IN ('Unlinked document', 'Missing invoice date') THEN 'document' ELSE 'other' END AS part, count(*) AS n FROM findings GROUP BY 1""")
def health_breakdown(spark, d):
    return health.breakdown(_findings(spark, d))


@query(f"""WITH {FINDINGS_SQL}, reviews AS (SELECT issue_key, CASE WHEN right(entity_id, 1) = '3' THEN 'resolved' ELSE 'reviewed' END AS resolution_status FROM findings WHERE right(entity_id, 1) IN ('3', '7'))
SELECT f.*, coalesce(r.n, 0) > 0 AS reviewed FROM findings f LEFT JOIN (SELECT issue_key, count(*) AS n, bool_or(resolution_status = 'resolved') AS gone FROM reviews GROUP BY 1) r USING (issue_key) WHERE NOT coalesce(gone, FALSE)""")
def health_open(spark, d):
    found = _findings(spark, d)
    last = F.right("entity_id", F.lit(1))
    reviews = found.where(last.isin("3", "7")).select("issue_key", F.when(last == "3", "resolved").otherwise("reviewed").alias("resolution_status"))
    return health.open_findings(found, reviews)


@query("""WITH checks AS (
SELECT 'line_part' AS check_name, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)
UNION ALL SELECT 'line_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'supplier_nation', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'label_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'es')
UNION ALL SELECT 'document_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT check_name, n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM checks""")
def integrity_snapshot(spark, d):
    t = lambda n: table(spark, d, n)
    parts = [
        health.orphans(t("lineitem"), "l_partkey", t("part").where("p_size <= 45"), "p_partkey", "line_part"),
        health.orphans(t("lineitem"), "l_orderkey", t("orders").where("o_orderstatus <> 'P'"), "o_orderkey", "line_order"),
        health.orphans(t("orders"), "o_custkey", t("customer"), "c_custkey", "order_customer"),
        health.orphans(t("supplier"), "s_nationkey", t("nation"), "n_nationkey", "supplier_nation"),
        health.orphans(t("labels"), "doc_id", t("documents").where("lang <> 'es'"), "doc_id", "label_document"),
        health.orphans(t("documents"), "doc_id", t("labels"), "doc_id", "document_label"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return health.integrity_status(out)


@query("""SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS line_key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def duplicate_key_groups(spark, d):
    return table(spark, d, "lineitem").groupBy(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("line_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT user_id, CAST(sum(CASE WHEN regexp_matches(v, '^[0-9]+$') THEN CAST(v AS BIGINT) ELSE 0 END) AS BIGINT) AS bytes, count(*) AS n
FROM (SELECT user_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS v FROM events) GROUP BY 1""")
def byte_totals(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("v"))
    return e.groupBy("user_id").agg(health.byte_total("v").alias("bytes"), F.count(F.lit(1)).alias("n"))


# --- keys, arithmetic, similarity -------------------------------------------------------------------------------

@query(f"""SELECT s_suppkey, {NORM('s_name')} AS norm_key, regexp_replace(upper(s_name), '[^A-Z0-9]+', '', 'g') AS compact_key,
translate(regexp_replace(upper(s_name), '[^A-Z0-9]+', '', 'g'), 'ILOSB', '11058') AS skeleton,
trim(regexp_replace(regexp_replace(lower(s_name || ' Private Ltd Co'), '\\b(pte|ltd|limited|private|co|company)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS company FROM supplier""")
def supplier_keys(spark, d):
    return table(spark, d, "supplier").select(
        "s_suppkey", norm("s_name").alias("norm_key"), compact("s_name").alias("compact_key"), ocr_skeleton("s_name").alias("skeleton"), supplier_key(F.concat("s_name", F.lit(" Private Ltd Co"))).alias("company")
    )


@query(f"""SELECT p_partkey, {NORM('p_name')} AS name_key,
trim(regexp_replace(regexp_replace(regexp_replace({NORM("'Supply of the ' || p_name || ' 12 mm with pair'")}, '\\b(?:the|a|an|supply|install|installation|dismantle|dismantled|dismantling|dismount|dismounted|dismounting|commissioning|service|services|labour|labor|with|for|in pair|pair)\\b', ' ', 'g'),
'\\b\\d+(?:\\.\\d+)?\\s*(?:mm|cm|inch|inches|lumens?|ansi|hz|khz|mhz|ghz|w|kw)\\b', ' ', 'g'), ' +', ' ', 'g')) AS identity FROM part""")
def item_identity_keys(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", standard_item_name_key("p_name", ascii_only=True).alias("name_key"), normalized_item_identity(F.concat(F.lit("Supply of the "), "p_name", F.lit(" 12 mm with pair"))).alias("identity")
    )


def _econ(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("q"), half_up_2(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_extendedprice").alias("a"))


ECON_SQL = "econ AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity AS q, floor(l_extendedprice / l_quantity * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS p, l_extendedprice AS a FROM lineitem)"


@query(f"""WITH {ECON_SQL} SELECT l_returnflag, count(*) AS n, count(*) FILTER (abs(q * p - a) <= greatest(0.02::DOUBLE, abs(a) * 0.0005::DOUBLE)) AS n_ok FROM econ GROUP BY 1""")
def row_arithmetic_audit(spark, d):
    return _econ(spark, d).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(econ_ok(F.col("q"), F.col("p"), F.col("a"), "line_audit")).alias("n_ok"))


@query("WITH " + ECON_SQL + "\n" + "\nUNION ALL ".join(
    f"SELECT '{n}' AS profile, count(*) FILTER (q > 0 AND abs(q * p - a) <= greatest({t}::DOUBLE, abs(a) * {r}::DOUBLE)) AS n_ok FROM econ" for n, (t, r) in PROFILES.items()))
def tolerance_matrix(spark, d):
    q, p, a = F.col("q"), F.col("p"), F.col("a")
    one = _econ(spark, d).agg(*[F.count_if(econ_ok(q, p, a, n)).alias(n) for n in PROFILES])
    return one.unpivot([], list(PROFILES), "profile", "n_ok")


@query("""WITH s AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS line_sum FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN line_sum IS NULL THEN 'no-lines' WHEN abs(CAST(line_sum AS DOUBLE) - o_totalprice) <= greatest(0.05::DOUBLE, abs(o_totalprice) * 0.0005::DOUBLE) THEN 'agrees' ELSE 'differs' END AS status
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def document_arithmetic(spark, d):
    from ..functions.economics import within

    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("line_sum"))
    out = table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(s, "o_orderkey", "left")
    ok = within(F.col("line_sum").cast("double"), F.col("o_totalprice"), "line_sum")
    return out.select("o_orderkey", F.when(F.col("line_sum").isNull(), "no-lines").when(ok, "agrees").otherwise("differs").alias("status"))


def _tokens_sql(c: str, shortest: int, stop: bool) -> str:
    words = f"list_distinct(list_filter(string_split({NORM(c)}, ' '), lambda w: length(w) >= {shortest}))"
    return f"list_filter({words}, lambda w: NOT list_contains([{', '.join(repr(s) for s in STOP_WORDS)}], w))" if stop else words


def _similarity_sql(name: str) -> str:
    shortest, stop, den, both = MEASURES[name]
    x, y = _tokens_sql("a", shortest, stop), _tokens_sql("b", shortest, stop)
    size = "greatest" if den == "max" else "least"
    return f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN {both}::DOUBLE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / {size}(len({x}), len({y})) END AS {name}"


@query(f"""WITH pairs AS (SELECT p.p_partkey AS id, p.p_name || ' ' || p.p_type AS a, s.p_name || ' the set ' || s.p_brand AS b FROM part p JOIN part s ON s.p_partkey = p.p_partkey + 1)
SELECT id, {', '.join(_similarity_sql(n) for n in MEASURES)} FROM pairs""")
def similarity_measures(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("a"))
    b = p.select((F.col("p_partkey") - 1).alias("id"), F.concat_ws(" ", "p_name", F.lit("the set"), "p_brand").alias("b"))
    return a.join(b, "id").select("id", *[similarity("a", "b", n).cast("double").alias(n) for n in MEASURES])


# --- resolution -------------------------------------------------------------------------------------------------


def _named_items(spark, d):
    """Parts under a sku of brand and size, so that names and skus repeat."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("sku"), F.col("p_name").alias("item_name"), F.col("p_retailprice").alias("created"))


NAMED_SQL = f"""named AS (SELECT p_partkey AS id, regexp_replace(upper(p_brand || '-' || CAST(p_size AS VARCHAR)), '[^A-Z0-9]+', '', 'g') AS sku_key, {NORM('p_name')} AS name_key, p_retailprice AS created FROM part)"""


@query(f"""WITH {NAMED_SQL}, s AS (SELECT *, count(*) OVER (PARTITION BY name_key, sku_key) AS n_same, row_number() OVER (PARTITION BY name_key, sku_key ORDER BY created, id) AS place,
first_value(id) OVER (PARTITION BY name_key, sku_key ORDER BY created, id) AS canonical FROM named),
k AS (SELECT name_key, count(DISTINCT sku_key) AS n_skus FROM named GROUP BY 1)
SELECT id, s.name_key, sku_key, CASE WHEN n_same > 1 THEN CASE WHEN place = 1 THEN 'keep' ELSE 'merge' END END AS action, CASE WHEN n_same > 1 THEN canonical END AS canonical_id, n_skus > 1 AS review
FROM s JOIN k USING (name_key) WHERE n_same > 1 OR n_skus > 1""")
def master_duplicate_policy(spark, d):
    return resolve.duplicate_policy(_named_items(spark, d), ascii_only=True)


@query(f"WITH {NAMED_SQL} SELECT name_key, sku_key, min(id) AS id_a, max(id) AS id_b FROM named GROUP BY 1, 2 HAVING count(*) = 2")
def safe_duplicate_groups(spark, d):
    it = _named_items(spark, d).select("id", compact("sku").alias("sku_key"), standard_item_name_key("item_name", ascii_only=True).alias("name_key"))
    return it.groupBy("name_key", "sku_key").agg(F.min("id").alias("id_a"), F.max("id").alias("id_b"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


@query(f"WITH {_alike_sql("SELECT p_partkey AS id, p_name || ' ' || p_type AS t FROM part")} SELECT id, class_id, n_links, first_id FROM alike")
def duplicate_pairs_blocked(spark, d):
    """All parts against all: the class of equal words each belongs to, and the number of parts that look alike."""
    return resolve.linked_items(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("item_name")), 0.72)


@query(f"""WITH it AS (SELECT p_partkey AS id, regexp_replace(upper(p_brand || '-' || CAST(p_size AS VARCHAR)), '[^A-Z0-9]+', '', 'g') AS k, {NORM('p_name')} AS n FROM part WHERE p_partkey % 3 <> 0),
ln AS (SELECT p_partkey AS line_id, CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(upper(p_brand || '-' || CAST(p_size AS VARCHAR)), '[^A-Z0-9]+', '', 'g') ELSE '' END AS k, {NORM('p_name')} AS n FROM part),
bs AS (SELECT k, min(id) AS sku_id FROM it GROUP BY 1),
bn AS (SELECT n, count(DISTINCT k) AS models, min(k) AS model, min(id) AS first FROM it GROUP BY 1),
j AS (SELECT line_id, CASE WHEN ln.k <> '' AND sku_id IS NOT NULL THEN 'exact-sku' WHEN first IS NULL THEN 'no-existing-match' WHEN models > 1 THEN 'conflicting-existing-models'
 WHEN models = 1 AND ln.k <> '' AND ln.k <> model THEN 'incoming-model-conflict' WHEN models = 1 THEN 'same-name-single-verified-model' ELSE 'same-normalized-name' END AS reason, sku_id, first
 FROM ln LEFT JOIN bs ON bs.k = ln.k LEFT JOIN bn ON bn.n = ln.n)
SELECT line_id, reason, CASE WHEN reason = 'exact-sku' THEN sku_id WHEN reason LIKE 'same-%' THEN first END AS item_id FROM j""")
def exact_or_fallback_match(spark, d):
    it = _named_items(spark, d)
    lines = it.select(F.col("id").alias("line_id"), F.when(F.col("id") % 2 == 0, F.col("sku")).alias("sku"), "item_name")
    return resolve.match_exact_or_name(lines, it.where("id % 3 <> 0"))


@query()
def fuzzy_sku_match(spark, d):
    """Each part read with look-alike characters, every seventh with one character too few and every fifth name cut short."""
    it = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("sku"), F.col("p_name").alias("item_name"))
    misread = F.when(F.col("id") % 7 == 0, F.expr("substring(sku, 2)")).otherwise(F.translate("sku", "015", "OIS"))
    name = F.when(F.col("id") % 5 == 0, F.expr("left(item_name, length(item_name) - 2)")).otherwise(F.col("item_name"))
    return resolve.fuzzy_top(it.select(F.col("id").alias("line_id"), misread.alias("sku"), name.alias("item_name")), it)


@query(f"""WITH {NAMED_SQL}, m AS (SELECT id, first_value(id) OVER (PARTITION BY name_key, sku_key ORDER BY created, id) AS canonical FROM named),
a AS (SELECT coalesce(canonical, l_partkey) AS item_id, CAST(l_quantity AS DECIMAL(14,2)) AS quantity FROM lineitem LEFT JOIN m ON id = l_partkey)
SELECT item_id, count(*) AS n_lines, CAST(sum(quantity) AS DECIMAL(24,2)) AS quantity FROM a GROUP BY 1""")
def merge_remap_invariants(spark, d):
    merges = resolve.duplicate_policy(_named_items(spark, d), ascii_only=True).where("action = 'merge'").select("id", "canonical_id")
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("decimal(14,2)").alias("quantity"))
    after = resolve.remap(lines, "item_id", merges)
    checked = resolve.assert_same_totals(lines, after, "quantity").where("checked")
    out = after.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").cast("decimal(24,2)").alias("quantity"))
    return out.join(F.broadcast(checked.select("checked"))).drop("checked")  # one row: nothing comes out if totals differ


# --- ledger, votes, ranking -------------------------------------------------------------------------------------


def _readings(spark, d):
    """Order lines as rows of three extractors, told apart by the return flag."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("origin"), F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("decimal(14,2)").cast("string")).alias("row_key"),
        (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("ordinal"), F.col("l_extendedprice").cast("decimal(14,2)").alias("amount"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("decimal(14,2)").alias("quantity"),
    )


@query("""WITH r AS (SELECT CAST(l_partkey AS VARCHAR) || '|' || CAST(CAST(l_quantity AS DECIMAL(14,2)) AS VARCHAR) AS row_key, l_returnflag AS origin FROM lineitem),
o AS (SELECT row_key, origin, row_number() OVER (PARTITION BY origin, row_key) AS occurrence FROM r)
SELECT row_key, CAST(occurrence AS INT) AS occurrence, count(DISTINCT origin) AS n_origins FROM o GROUP BY 1, 2""")
def ledger_with_occurrence(spark, d):
    r = spread(_readings(spark, d), table(spark, d, "lineitem"), "row_key")  # numbered and counted where they lie
    return ledger.with_occurrence(r, "row_key", "origin", "ordinal").groupBy("row_key", "occurrence").agg(F.count_distinct("origin").alias("n_origins"))


@query("""WITH r AS (SELECT CAST(l_partkey AS VARCHAR) || '|' || CAST(CAST(l_quantity AS DECIMAL(14,2)) AS VARCHAR) AS row_key, l_returnflag AS origin FROM lineitem),
o AS (SELECT DISTINCT row_key, origin, row_number() OVER (PARTITION BY origin, row_key) AS occurrence FROM r)
SELECT row_key, CAST(occurrence AS INT) AS occurrence FROM o WHERE origin = 'A' AND (row_key, occurrence) NOT IN (SELECT row_key, occurrence FROM o WHERE origin = 'N')""")
def ledger_vs_final(spark, d):
    rows = ledger.with_occurrence(spread(_readings(spark, d), table(spark, d, "lineitem"), "row_key"), "row_key", "origin", "ordinal")
    return ledger.missing_from(rows.where("origin = 'A'").select("row_key", "occurrence"), rows.where("origin = 'N'"), "row_key")


@query("""SELECT signature, count(*) AS n, CAST(sum(amount) AS DECIMAL(28,2)) AS amount FROM (SELECT CAST(l_partkey AS VARCHAR) || '|' || CAST(CAST(l_quantity AS DECIMAL(14,2)) AS VARCHAR) AS signature, CAST(l_extendedprice AS DECIMAL(14,2)) AS amount,
row_number() OVER (PARTITION BY l_partkey, CAST(l_quantity AS DECIMAL(14,2)) ORDER BY l_orderkey, l_linenumber * 1000000 + l_suppkey, CAST(l_extendedprice AS DECIMAL(14,2))) AS k FROM lineitem) WHERE k = 1 GROUP BY 1""")
def exact_row_dedupe(spark, d):
    r = ledger.dedupe_exact(_readings(spark, d), "row_key", "doc_id", "ordinal", "amount")
    return r.groupBy(F.col("row_key").alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(28,2)").alias("amount"))


@query("""WITH s AS (SELECT l_partkey AS part, count(*) AS n, min(CAST(l_quantity AS DECIMAL(14,2))) = max(CAST(l_quantity AS DECIMAL(14,2))) AS alike FROM lineitem GROUP BY 1),
t AS (SELECT CASE WHEN n = 1 THEN 'single' WHEN alike THEN 'collapsed' ELSE 'conflict' END AS status, 1 AS k FROM s
UNION ALL SELECT CASE WHEN alike THEN 'duplicate-collapsed' ELSE 'conflict-member' END, n - 1 FROM s WHERE n > 1)
SELECT status, CAST(sum(k) AS BIGINT) AS n FROM t GROUP BY 1""")
def unique_sku_consolidation(spark, d):
    r = _readings(spark, d)
    return ledger.consolidate_sku(r, "part", "quantity", F.col("amount"), "doc_id", "ordinal").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT l_orderkey AS doc_id, CAST(l_quantity AS INT) % 5 AS v, count(DISTINCT l_returnflag) AS votes FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, v DESC) AS n, lead(votes) OVER (PARTITION BY doc_id ORDER BY votes DESC, v DESC) AS second FROM v)
SELECT doc_id, CASE WHEN coalesce(second = votes, FALSE) OR votes < 2 THEN NULL ELSE v END AS value, votes, CASE WHEN coalesce(second = votes, FALSE) THEN 'tie' WHEN votes < 2 THEN 'weak' ELSE 'resolved' END AS status FROM r WHERE n = 1""")
def field_vote(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity").cast("int") % 5).alias("v"), "l_returnflag")
    return ledger.vote(r, ["doc_id"], "v", "l_returnflag")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_suppkey AS value, l_quantity + 70 AS score, l_returnflag AS source FROM lineitem),
g AS (SELECT doc_id, value, max(score) AS best, sum(CAST(score AS DECIMAL(14,2))) AS total, count(DISTINCT source) AS support FROM c GROUP BY 1, 2),
k AS (SELECT *, best + least(30.0::DOUBLE, CAST(total AS DOUBLE) / 10) + support * 8 AS rank_score FROM g),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank_score DESC, value) AS place, lead(best) OVER (PARTITION BY doc_id ORDER BY rank_score DESC, value) AS second FROM k),
s AS (SELECT *, CASE WHEN best < 90 THEN 'insufficient-evidence' WHEN coalesce(second >= 90 AND abs(best - second) < 20, FALSE) THEN 'conflicting-evidence' ELSE 'resolved' END AS status FROM w WHERE place = 1)
SELECT doc_id, CASE WHEN status = 'resolved' THEN value END AS value, support, status FROM s""")
def header_choice(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("value"), (F.col("l_quantity") + 70).alias("score"), F.col("l_returnflag").alias("source"))
    return ledger.choose_header(c, ["doc_id"])


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS state FROM orders)
SELECT o_custkey, arg_min(priority, (-o_totalprice, o_orderkey)) FILTER (priority IS NOT NULL) AS priority, arg_min(state, (-o_totalprice, o_orderkey)) FILTER (state IS NOT NULL) AS state FROM o GROUP BY 1""")
def header_backfill(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("state"))
    return ledger.backfill(o, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], ["priority", "state"])


def _candidate_rows(spark, d):
    raw = table(spark, d, "lineitem")
    li = raw.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    price = half_up_2(F.col("amount") / F.col("quantity")) + F.when(F.col("l_suppkey") % 4 == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    rows = li.join(p, "l_partkey").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("origin"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("ordinal"), (F.col("l_partkey") % 40).cast("string").alias("sku"),
        F.col("p_name").alias("item_name"), "quantity", price.alias("unit_price"), "amount",
    )
    return spread(rows, raw, "doc_id")


CANDIDATES_SQL = """rows AS (SELECT l_orderkey AS doc_id, l_returnflag AS origin, l_linenumber * 1000000 + l_suppkey AS ordinal, CAST(l_partkey % 40 AS VARCHAR) AS identity, l_quantity AS q,
 floor(l_extendedprice / l_quantity * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE + CASE WHEN l_suppkey % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p, l_extendedprice AS a FROM lineitem JOIN part ON p_partkey = l_partkey),
judged AS (SELECT *, abs(q * p - a) <= greatest(0.03::DOUBLE, abs(a) * 0.003::DOUBLE) AS ok FROM rows),
firsts AS (SELECT doc_id, identity, origin AS other, q AS oq, p AS op, a AS oa FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, identity, origin ORDER BY ordinal, q, p, a) AS k FROM rows) WHERE k = 1),
support AS (SELECT doc_id, origin, ordinal, bool_or(q = oq AND abs(p - op) <= 0.01::DOUBLE AND abs(a - oa) <= 0.01::DOUBLE) AS agreed FROM rows JOIN firsts USING (doc_id, identity) WHERE origin <> other GROUP BY 1, 2, 3),
sup AS (SELECT doc_id, origin, count(*) AS supported, count(*) FILTER (agreed) AS agreed FROM support GROUP BY 1, 2),
sets AS (SELECT doc_id, origin, count(*) AS n_rows, sum(28 + CASE WHEN ok THEN 42 ELSE -70 END) AS pts, count(DISTINCT identity) AS ids, sum(CAST(a AS DECIMAL(18,2))) AS amount_sum, count(*) FILTER (NOT ok) AS unresolved FROM judged GROUP BY 1, 2),
scored AS (SELECT doc_id, origin, n_rows, amount_sum, unresolved, o_totalprice AS subtotal,
 CAST(pts + coalesce(supported, 0) * 10 + coalesce(agreed, 0) * 10 + CASE WHEN abs(CAST(amount_sum AS DOUBLE) - o_totalprice) <= greatest(0.05::DOUBLE, abs(o_totalprice) * 0.004::DOUBLE) THEN 55 ELSE -25 END - (n_rows - ids) * 35 - unresolved * 8 AS BIGINT) AS score
 FROM sets LEFT JOIN sup USING (doc_id, origin) JOIN orders ON o_orderkey = doc_id),
ranked AS (SELECT *, row_number() OVER w AS k, score - coalesce(lead(score) OVER w, score) AS margin FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, origin)),
best AS (SELECT *, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (score + 80)::DOUBLE / 260)) * greatest(0.45::DOUBLE, least(1.0::DOUBLE, 0.55::DOUBLE + greatest(0, margin)::DOUBLE / 180)) * 1000 + 0.5::DOUBLE) / 1000 AS confidence FROM ranked WHERE k = 1)"""


@query(f"WITH {CANDIDATES_SQL} SELECT doc_id, origin, score, margin, confidence FROM best")
def candidate_set_ranking(spark, d):
    subtotals = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("subtotal"))
    return consensus.rank_sets(consensus.assess_sets(_candidate_rows(spark, d), subtotals)).select("doc_id", "origin", "score", "margin", F.col("confidence").cast("double").alias("confidence"))


@query(f"""WITH {CANDIDATES_SQL},
acc AS (SELECT best.doc_id, bool_or(NOT ok) AS mismatch, coalesce(sum(CAST(a AS DECIMAL(18,2))) FILTER (ok), 0) AS accepted FROM best JOIN judged ON judged.doc_id = best.doc_id AND judged.origin = best.origin GROUP BY 1),
why AS (SELECT doc_id, origin AS winner, score, confidence, concat_ws(',', CASE WHEN mismatch THEN 'economic-mismatch' END,
 CASE WHEN NOT abs(CAST(accepted AS DOUBLE) - subtotal) <= greatest(0.06::DOUBLE, abs(subtotal) * 0.002::DOUBLE) THEN 'subtotal-mismatch' END, CASE WHEN confidence < 0.72 THEN 'low-confidence' END) AS reasons FROM best JOIN acc USING (doc_id))
SELECT doc_id, winner, score, confidence, CASE WHEN reasons = '' THEN 'accepted' ELSE 'review' END AS status, reasons FROM why""")
def pipeline_verdicts(spark, d):
    subtotals = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("subtotal"))
    return consensus.verdicts(_candidate_rows(spark, d), subtotals).select("doc_id", "winner", "score", F.col("confidence").cast("double").alias("confidence"), "status", "reasons")


@query()
def greedy_match(spark, d):
    r = _candidate_rows(spark, d)
    return matching.greedy_matches(r.select("doc_id", F.when(F.col("origin") == "N", "primary").otherwise("secondary").alias("side"), F.col("ordinal").alias("no"), "sku", F.col("item_name").alias("name"), "quantity", "unit_price", "amount"))


# --- authority, classes, text -----------------------------------------------------------------------------------


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'accept' WHEN role = 'system' THEN 'reject' END AS mark FROM conversations),
s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM m)
SELECT conv_id, turn, state, coalesce(state = 'accept', FALSE) AS allowed FROM s""")
def page_authority_state(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "accept").when(F.col("role") == "system", "reject").alias("mark"))
    return authority.page_authority(c, "conv_id", "turn", "mark").select("conv_id", "turn", "state", "allowed")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bound_to FROM conversations""")
def serial_asof_binding(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return authority.bind_to_previous(c, "conv_id", "turn", F.col("role") == "user", "turn").drop("role")


RENDER_SQL = """lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_extendedprice AS a,
 p_name || CASE l_partkey % 5 WHEN 0 THEN ' installation' WHEN 1 THEN ' wall mount' WHEN 2 THEN ' projector' WHEN 3 THEN ' microphone stand' ELSE ' warranty' END || ' MX' || CAST(l_partkey AS VARCHAR) AS name FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _rendered(spark, d):
    """Lines as they would be printed: what stands in them is known, so reading them back can be checked."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    kind = F.col("l_partkey") % 5
    word = F.when(kind == 0, " installation").when(kind == 1, " wall mount").when(kind == 2, " projector").when(kind == 3, " microphone stand").otherwise(" warranty")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("a"), F.concat("p_name", word, F.lit(" MX"), F.col("l_partkey").cast("string")).alias("name"))


@query(f"""WITH {RENDER_SQL}, c AS (SELECT CASE l_partkey % 5 WHEN 0 THEN 'service' WHEN 1 THEN 'accessory' WHEN 4 THEN 'warranty' ELSE 'equipment' END AS line_class FROM lines)
SELECT line_class, count(*) AS n FROM c GROUP BY 1""")
def line_type_classification(spark, d):
    return authority.line_classes(_rendered(spark, d).select("name"), "name").groupBy("line_class").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Projector lens' WHEN 1 THEN 'Amplified speaker' WHEN 2 THEN 'Touch MONITOR' ELSE p_type END AS t FROM part)
SELECT CASE WHEN lower(t) LIKE '%project%' THEN 'Projection' WHEN lower(t) LIKE '%speaker%' THEN 'Audio' WHEN lower(t) LIKE '%monitor%' THEN 'Display' ELSE t END AS category, count(*) AS n FROM t GROUP BY 1""")
def category_inference(spark, d):
    k = F.col("p_partkey") % 4
    t = F.when(k == 0, "Projector lens").when(k == 1, "Amplified speaker").when(k == 2, "Touch MONITOR").otherwise(F.col("p_type"))
    return table(spark, d, "part").select(t.alias("t")).groupBy(authority.category("t").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RENDER_SQL} SELECT l_orderkey, l_linenumber, l_suppkey, 'MX' || CAST(l_partkey AS VARCHAR) AS model, q AS quantity, CAST(CAST(a AS DECIMAL(14,2)) AS DOUBLE) AS amount FROM lines""")
def parse_rendered_lines(spark, d):
    """Prints every line as text and reads model, quantity and amount back."""
    printed = F.concat_ws("  ", "name", F.concat_ws(" ", F.lit("qty:"), F.col("q").cast("int").cast("string")), F.concat(F.lit("$"), F.format_number("a", 2)))
    r = _rendered(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", printed.alias("line"))
    return r.select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.try_element_at(model_tokens(F.regexp_extract("line", r"^(.*?)  qty:", 1)), F.lit(-1)).alias("model"),
        F.regexp_extract("line", r"qty: (\d+)", 1).try_cast("double").alias("quantity"), money(F.try_element_at(money_tokens("line"), F.lit(-1))).alias("amount"),
    )


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""")
def day_first_dates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "d/M/yyyy").alias("printed"))
    return o.select("o_orderkey", parse_day_first("printed").alias("day"))


@query("""SELECT prefix_key, count(*) AS n, min(doc_id) AS first_id FROM (SELECT sha256(left(text, 5000)) AS prefix_key, doc_id FROM documents) GROUP BY 1 HAVING count(*) > 1""")
def text_dedupe_prefix(spark, d):
    t = table(spark, d, "documents").select(F.sha2(F.left("text", F.lit(5000)).cast("binary"), 256).alias("prefix_key"), "doc_id")
    return t.groupBy("prefix_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes FROM documents")
def content_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def evidence_containment(spark, d):
    """Documents that hold the whole text of a benchmark item, wherever it stands in their lines."""
    return evidence.contained_texts(table(spark, d, "documents"), table(spark, d, "benchmark"))


# --- audit and intelligence -------------------------------------------------------------------------------------

NEAR_SQL = """near AS (SELECT a.event_id AS lead_id, b.event_id AS follow_id, a.user_id AS actor, a.ts AS lead_ts FROM events a JOIN events b ON a.user_id = b.user_id
 WHERE a.event_type = 'purchase' AND b.event_type = 'view' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000)"""


@query(f"WITH {NEAR_SQL} SELECT lead_id, follow_id, actor FROM near")
def near_time_suppression(spark, d):
    return audit.hide_near(table(spark, d, "events"), "purchase", "view", 600)


@query(f"""WITH {NEAR_SQL}, own AS (SELECT follow_id, arg_max(lead_id, (lead_ts, lead_id)) AS lead_id FROM near GROUP BY 1), c AS (SELECT lead_id, count(*) AS n FROM own GROUP BY 1)
SELECT event_id, event_type, CASE WHEN event_type = 'purchase' THEN coalesce(n, 0) END AS n_hidden FROM events LEFT JOIN c ON lead_id = event_id WHERE event_id NOT IN (SELECT follow_id FROM own)""")
def audit_consolidation(spark, d):
    return audit.consolidate(table(spark, d, "events"), "purchase", "view", 600).select("event_id", "event_type", "n_hidden")


@query("""WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 3600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY 1, 2""")
def events_session_feed(spark, d):
    return audit.sessions(table(spark, d, "events"), 3600)


@query("""WITH s AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 7 <> 0), t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 11 <> 0)
SELECT coalesce(s.doc_id, t.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'INSERT' WHEN t.doc_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action
FROM s FULL JOIN t ON s.doc_id = t.doc_id WHERE s.quality IS DISTINCT FROM t.quality OR s.toxic IS DISTINCT FROM t.toxic""")
def snapshot_changes(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    after = lab.where("doc_id % 11 <> 0").withColumn("quality", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return audit.snapshot_changes(lab.where("doc_id % 7 <> 0"), after, "doc_id").select("doc_id", "action")


@query("""WITH b AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(s_name), '\\b(pte|ltd|limited|private|co|company)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS supplier_key, l_returnflag AS field_name,
 CAST(l_quantity AS INT) AS s, CAST(l_quantity AS INT) // 2 * 2 AS c FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag IN ('N', 'A'))
SELECT supplier_key, field_name, CAST(s AS VARCHAR) AS source_value, CAST(c AS VARCHAR) AS corrected_value FROM b WHERE s <> c AND NOT (field_name = 'A' AND s < 25)""")
def correction_anti_insert(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    q = F.col("l_quantity").cast("int")
    batch = li.select(F.col("s_name").alias("supplier"), F.col("l_returnflag").alias("field_name"), q.cast("string").alias("source_value"), (F.floor(q / 2) * 2).cast("int").cast("string").alias("corrected_value"))
    known = batch.where((F.col("field_name") == "A") & (F.col("source_value").cast("int") < 25)).select(supplier_key("supplier").alias("supplier_key"), "field_name", "source_value", "corrected_value", F.lit("approved").alias("status"))
    return gates.new_corrections(batch, known, ("N", "A"))


@query("""WITH o AS (SELECT o_custkey AS supplier_key, count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS old_n, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS new_n, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY 1)
SELECT CAST(supplier_key AS VARCHAR) AS supplier_key, old_n + new_n AS sample_count, first_seen, last_seen FROM o""")
def profile_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("supplier_key"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("labels"), F.col("o_orderdate").alias("seen_at"))
    cut = F.lit("1996-01-01").cast("timestamp")
    old = o.where(F.col("seen_at") < cut).groupBy("supplier_key").agg(F.max_by("labels", "seen_at").alias("labels"), F.count(F.lit(1)).alias("sample_count"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    return gates.upsert_profiles(old, o.where(F.col("seen_at") >= cut)).drop("labels")


@query(f"""WITH {ECON_SQL}, v AS (SELECT l_orderkey, bool_or(abs(q * p - a) > 0.06::DOUBLE OR a > 90000) AS bad FROM econ GROUP BY 1)
SELECT econ.l_orderkey AS doc_id, count(*) AS n_lines FROM econ JOIN v USING (l_orderkey) WHERE NOT bad GROUP BY 1""")
def save_gate(spark, d):
    r = _econ(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.when(F.col("a") <= 90000, "item").alias("item_name"), F.col("q").alias("quantity"), F.col("p").alias("unit_price"), F.col("a").alias("amount"))
    return gates.publishable(r, gates.save_violations(r)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
