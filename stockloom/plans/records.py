"""Registered queries about records and their history: searches, filters, top lists, JSON payloads, changes, gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import health_issue_key, norm
from ..functions.text import local_day
from ..operators import audit, authority, evidence, gates, ledger
from ..sources.views import table
from ..streaming import feed
from .queries import query


@query("""WITH hay AS (SELECT o_orderkey, o_orderpriority || ' ' || coalesce(string_agg(DISTINCT p_name, ' ' ORDER BY p_name), '') AS h FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey, o_orderpriority)
SELECT o_orderkey FROM hay WHERE trim(regexp_replace(lower(h), '[^a-z0-9]+', ' ', 'g')) LIKE '%high%' AND trim(regexp_replace(lower(h), '[^a-z0-9]+', ' ', 'g')) LIKE '%red%'""")
def document_search(spark, d):
    """Documents whose own fields and linked item names hold all words asked for."""
    names = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    names = names.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("names"))
    hay = norm(F.concat_ws(" ", "o_orderpriority", "names"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(names, "o_orderkey", "left").where(hay.contains("high") & hay.contains("red")).select("o_orderkey")


@query("""SELECT event_id, event_type, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM events WHERE event_type IN ('purchase', 'signup') AND CAST(ts + INTERVAL 8 HOUR AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND user_id < 100""")
def audit_filter(spark, d):
    """Events of some actions by some actors on local days, both ends included. The filters on stored columns reach the scan."""
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "signup") & (F.col("user_id") < 100))
    return e.select("event_id", "event_type", local_day(F.col("ts").cast("timestamp")).alias("day")).where("day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")


@query("""SELECT id, kind FROM (SELECT event_id AS id, 'feedback' AS kind, ts FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'notice', ts FROM events WHERE event_type = 'purchase') ORDER BY ts DESC, kind, id LIMIT 100""")
def feedback_inbox(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.lit("open").alias("status"), "event_type")
    return audit.inbox(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "open", 100).select("id", "kind")


@query("""SELECT user_id, count(*) AS n, CAST(sum(CAST(coalesce(json_extract_string(props, '$.k'), '0') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1""")
def audit_json_units(spark, d):
    """Sums over a field of JSON payloads; a missing field is zero."""
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(v, F.lit(0))).alias("k"))


@query("""WITH l AS (SELECT *, lag(o_orderstatus) OVER w AS s0, lag(o_orderpriority) OVER w AS p0, lag(o_orderkey) OVER w AS k0 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, 'status' AS field, s0 AS old_value, o_orderstatus AS new_value FROM l WHERE k0 IS NOT NULL AND s0 IS DISTINCT FROM o_orderstatus
UNION ALL SELECT o_orderkey, 'priority', p0, o_orderpriority FROM l WHERE k0 IS NOT NULL AND p0 IS DISTINCT FROM o_orderpriority""")
def change_summary(spark, d):
    """What differs between one order of a customer and the one before, field by field."""
    from pyspark.sql import Window

    now = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("string").alias("updated_at")))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", now.alias("new_data"))
    o = o.withColumn("old_data", F.lag("new_data").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("old_data IS NOT NULL")
    return audit.change_summary(o, "o_orderkey", "old_data", "new_data")


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS ordinal FROM conversations),
f AS (SELECT *, last_value(ordinal IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo, first_value(ordinal IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM t),
g AS (SELECT *, count(*) FILTER (ordinal IS NULL) OVER (PARTITION BY conv_id, lo, hi) AS n, row_number() OVER (PARTITION BY conv_id, lo, hi, ordinal IS NULL ORDER BY turn) AS k FROM f)
SELECT conv_id, turn, CAST(coalesce(ordinal, CASE WHEN hi - lo - 1 = n THEN lo + k END) AS BIGINT) AS filled FROM g""")
def ordinal_gap_fill(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("ordinal"))
    return ledger.fill_gaps(c, "conv_id", "turn", "ordinal").select("conv_id", "turn", F.col("filled").cast("bigint").alias("filled"))


@query("""WITH v AS (SELECT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) || '.' END AS name, c_custkey AS src FROM customer),
k AS (SELECT c_nationkey, regexp_replace(upper(name), '[^A-Z0-9]+', '', 'g') AS k, count(DISTINCT src) AS n, min(length(name)) AS l FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, l, k DESC) AS p FROM k)
SELECT c_nationkey, k AS segment, n AS votes FROM r WHERE p = 1""")
def description_consensus(spark, d):
    """The spelling that most sources share once case and marks are gone, in its shortest form."""
    spelt = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(".")))
    v = table(spark, d, "customer").select("c_nationkey", spelt.alias("name"), "c_custkey")
    out = evidence.shortest_popular(v, ["c_nationkey"], "name", "c_custkey")
    return out.select("c_nationkey", F.regexp_replace(F.upper("name"), "[^A-Z0-9]+", "").alias("segment"), "votes")


@query("""WITH t AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS page, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS pages, count(*) FILTER (length(line) % 3 = 0) AS accepted FROM t GROUP BY 1""")
def page_counts(spark, d):
    """Pages of a text and those that carry a mark of acceptance."""
    p = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"))
    p = p.withColumn("mark", F.when(F.length("line") % 3 == 0, "accept").otherwise("reject"))
    return authority.page_authority(p, "doc_id", "page", "mark").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("allowed").alias("accepted"))


@query("""WITH g AS (SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'A' THEN 'service' WHEN 'N' THEN 'equipment' ELSE 'other' END AS class, l_quantity > 45 AS strong FROM lineitem)
SELECT authority, count(*) AS n FROM (SELECT doc_id, CASE WHEN bool_or(strong) THEN 'equipment' WHEN bool_or(class = 'service') THEN 'service' ELSE 'uncertain' END AS authority FROM g GROUP BY 1) GROUP BY 1""")
def content_authority(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "service").when(F.col("l_returnflag") == "N", "equipment").otherwise("other")
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), kind.alias("class"), (F.col("l_quantity") > 45).alias("strong"))
    return authority.content_authority(r).groupBy("authority").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT l_returnflag, l_quantity AS q, floor(l_extendedprice / l_quantity * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE + CASE WHEN l_suppkey % 9 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS p, l_extendedprice AS a, l_suppkey % 2 = 0 AS proof FROM lineitem)
SELECT CASE WHEN l_returnflag = 'R' THEN 'reject' WHEN NOT abs(q * p - a) <= greatest(0.06::DOUBLE, abs(a) * 0.005::DOUBLE) THEN 'review' WHEN proof THEN 'verified' ELSE 'candidate' END AS level, count(*) AS n FROM e GROUP BY 1""")
def level_one_gate(spark, d):
    """Every line lands in exactly one of reject, review, verified and candidate."""
    from ..functions.economics import half_up_2

    li = table(spark, d, "lineitem")
    p = half_up_2(F.col("l_extendedprice") / F.col("l_quantity")) + F.when(F.col("l_suppkey") % 9 == 0, 5.0).otherwise(0.0)
    kind = F.when(F.col("l_returnflag") == "R", "service").otherwise("equipment")
    level = gates.level_one(kind, F.col("l_suppkey") % 2 == 0, F.col("l_quantity"), p, F.col("l_extendedprice"))
    return li.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey, 'name-review:supplier:' || lower(s_name) AS issue_key FROM supplier ORDER BY lower(s_name), s_suppkey""")
def issue_keys(spark, d):
    """Keys of findings for all suppliers, sorted without regard to case or accents."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", health_issue_key(F.lit("Name review"), F.lit("supplier"), F.col("s_name")).alias("issue_key"))
    return s.orderBy(F.collate("s_name", "UNICODE_CI_AI"), "s_suppkey").select("s_suppkey", "issue_key")


@query("""SELECT event_type, count(DISTINCT event_id) AS n, count(DISTINCT user_id) AS actors FROM events GROUP BY 1""")
def audit_feed_replay(spark, d):
    """The feed replayed as a stream: events once each, then counted. Equal to the batch answer."""
    schema = table(spark, d, "events").schema
    feed_rows = feed.read_feed(spark, f"{d}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type")
    seen = feed.drain(feed.distinct_events(feed_rows, late="3650 days"), "feed-replay")
    return seen.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("actors"))
