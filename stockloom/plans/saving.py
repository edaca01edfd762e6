"""Registered queries about mending, merging and saving what is known already."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import matching, stock
from ..sources import publish
from ..sources.cut import cut, shared_folder
from ..sources.views import table
from .documents import LINES_SQL, _lines
from .queries import query
from .recovery import _n, _numbered


@query()
def reading_merge(spark, d):
    """All order lines as known before, with prices that fail in style 1, codes and names missing in styles 2 and 3, mended by a later reading in the other order that lacks style 4 and has a further row in style 5."""
    r = _numbered(spark, d).withColumns({"code": F.concat(F.lit("MX"), _n("l_partkey")), "name": F.concat_ws(" ", "p_name", F.lit("projector")), "q": F.col("q").cast("double"), "a": F.col("a").cast("double")})
    style, sn = F.col("style"), F.array(F.concat(F.lit("SN"), _n("l_suppkey")))
    none = F.array().cast("array<string>")
    known = r.select("doc_id", F.col("k").alias("no"), F.when(style == 2, "").otherwise(F.col("code")).alias("sku"), F.when(style == 3, "").otherwise(F.col("name")).alias("item_name"), F.col("q").alias("quantity"), F.when(style == 1, F.col("p") * 2).otherwise(F.col("p")).alias("unit_price"), F.col("a").alias("amount"), none.alias("serials"))
    read = r.where(style != 4).select("doc_id", (1000 - F.col("k")).alias("no"), F.col("code").alias("sku"), F.col("name").alias("item_name"), F.col("q").alias("quantity"), F.col("p").alias("unit_price"), F.col("a").alias("amount"), sn.alias("serials"), (style != 6).alias("verified"))
    more = r.where(style == 5).select("doc_id", (2000 - F.col("k")).alias("no"), F.concat(F.lit("NEW"), _n("k")).alias("sku"), F.lit("ceiling speaker").alias("item_name"), F.lit(77.0).alias("quantity"), F.lit(3.0).alias("unit_price"), F.lit(231.0).alias("amount"), none.alias("serials"), F.lit(True).alias("verified"))
    out = matching.merge_readings(known, read.unionByName(more))
    return out.withColumn("serials", F.array_join("serials", ","))


@query("""WITH n AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name) AS first FROM part), pairs AS (SELECT first AS a, id AS b FROM n WHERE id <> first), d AS (SELECT a AS f, b AS t FROM pairs UNION SELECT b, a FROM pairs),
s AS (SELECT l_partkey AS item, CAST(l_suppkey % 500 AS VARCHAR) || 'S' || CAST(l_linenumber AS VARCHAR) AS serial FROM lineitem WHERE l_returnflag = 'N'),
b AS (SELECT l_partkey AS item, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(14,2))) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), r AS (SELECT l_partkey AS item, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(14,2))) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
f AS (SELECT id AS item, coalesce(b.n, 0) AS lines, coalesce(r.n, 0) AS adj, coalesce(b.q, 0) - coalesce(r.q, 0) AS stock FROM n LEFT JOIN b ON b.item = id LEFT JOIN r ON r.item = id),
sh AS (SELECT f, t, count(*) AS shared FROM d JOIN (SELECT DISTINCT * FROM s) x ON x.item = f JOIN (SELECT DISTINCT * FROM s) y ON y.item = t AND y.serial = x.serial GROUP BY 1, 2)
SELECT d.f AS from_id, d.t AS to_id, x.lines AS lines_moved, x.adj AS adjustments_moved, x.lines AS serials_moved, CAST(x.stock AS DOUBLE) AS stock_from, CAST(y.stock AS DOUBLE) AS stock_to, CAST(x.stock + y.stock AS DOUBLE) AS stock_after, coalesce(shared, 0) AS shared_serials,
 CASE WHEN coalesce(shared, 0) > 0 AND x.stock + y.stock < 0 THEN 'shared-serials,negative-stock' WHEN coalesce(shared, 0) > 0 THEN 'shared-serials' WHEN x.stock + y.stock < 0 THEN 'negative-stock' ELSE '' END AS blockers
FROM d JOIN f x ON x.item = d.f JOIN f y ON y.item = d.t LEFT JOIN sh ON sh.f = d.f AND sh.t = d.t""")
def merge_impact(spark, d):
    """What merging each part with the first of its name would do, both ways."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    pairs = items.join(items.groupBy("p_name").agg(F.min("id").alias("a")), "p_name").where("id <> a").select("a", F.col("id").alias("b"))
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("decimal(14,2)").alias("quantity"), "l_returnflag", F.concat_ws("", (F.col("l_suppkey") % 500).cast("string"), F.lit("s"), _n("l_linenumber")).alias("serial"))
    bought = li.where("l_returnflag = 'N'")
    out = stock.merge_impact(pairs, bought, li.where("l_returnflag = 'R'"), bought)
    return out.withColumn("blockers", F.array_join("blockers", ",")).withColumns({c: F.col(c).cast("double") for c in ("stock_from", "stock_to", "stock_after")})


@query(f"""WITH {LINES_SQL}, o AS (SELECT o_orderkey, o_orderstatus FROM orders)
SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN a * 2 ELSE a END) AS DECIMAL(24,2)) AS amount FROM li JOIN o ON o_orderkey = doc_id GROUP BY 1""")
def published_invoices(spark, d):
    """All orders saved, those of one status saved again with other amounts, and the same once more; read back."""
    root = f"{shared_folder(spark)}/books-{uuid.uuid4().hex}"
    lines = _lines(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus"), "doc_id").select("doc_id", "ord", "l_partkey", "a", "o_orderstatus")
    lines = cut(lines, "saved")  # three publications read it four times each
    changed = lines.where("o_orderstatus = 'F'").withColumn("a", (F.col("a") * 2).cast("decimal(14,2)"))
    for part in (lines, changed, changed):
        publish.publish(root, {"lines": part.drop("o_orderstatus"), "purchases": part.select("doc_id", "o_orderstatus").distinct()})
    rows = publish.saved(spark, root, "lines", "doc_id long, ord long, l_partkey long, a decimal(14,2)")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("a").cast("decimal(24,2)").alias("amount"))
