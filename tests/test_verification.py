"""Verification operators on small literal tables."""

from pyspark.sql import functions as F

from stockloom.functions.economics import econ_ok
from stockloom.operators import authority, parsers
from stockloom.operators import verification as v

ROW = "doc_id long, row_no int, sku string, item_name string, quantity double, unit_price double, amount double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_refusals_name_their_first_reason(spark):
    header = "supplier string, number string, reference string, day string"
    told = [
        ("1RafflesInstitution", "Lane", "reject"), ("", "123 Example Road Singapore 123456", "address-metadata"), ("", "Example AV Pte Ltd", "document-supplier"), ("INV-12345", "", "document-invoice-number"),
        ("VSO17-035483", "VSO17-035483", "document-reference-number"), ("", "15/12/2023", "date-metadata"), ("", "Dismantle existing projector and install replacement projector", "service-or-labour"),
        ("CQ12T", "Digital mixer console", None), ("", "Supply & install projector", None), ("", "HDMI cable", "excluded-accessory"), ("", "Microphone stand", None), ("", "Extended warranty", "warranty-or-support"),
        ("", "Projector with 3 year warranty", None), (None, None, "empty-row"), ("", "Sold to", "header-or-contact-metadata"), ("", "Other Trading Limited", "company-header"), ("LABOUR", "works", "service-or-labour"),
    ]
    df = spark.createDataFrame([(i, s, n, "Example AV Pte Ltd", "INV-12345", "VSO17-035483", "2023-12-15") for i, (s, n, _) in enumerate(told)], f"i int, sku string, item_name string, {header}")
    got = {r.i: r.refused for r in v.judged(df, {"supplier": "supplier", "invoice-number": "number", "reference-number": "reference", "invoice-date": "day"}).collect()}
    for i, (_, _, why) in enumerate(told):
        assert (got[i] is not None) if why == "reject" else got[i] == why, told[i]
    assert v.judged(df.limit(0)).count() == 0


def test_proof_gate_and_verdict(spark):
    text = "TAX INVOICE\nCQ12T Digital mixer console 1 1400.00 1400.00\nWireless microphone system\n2 50.00 100.00\nMX-12 Lens 3 10.00 30.00\nMX123 Hood"
    lines = parsers.lines_of(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    told = [
        (1, 1, "CQ12T", "", 1.0, 1400.0, 1400.0), (1, 2, "", "Wireless microphone", 2.0, 50.0, 100.0), (1, 3, "MX12", "", 3.0, 10.0, 30.0), (1, 4, "MX1", "", 3.0, 10.0, 30.0), (1, 5, "CQ12T", "", 7.0, 1.0, 7.0),
        (1, 6, "CQ12T", None, None, None, None), (1, 7, None, None, 1.0, 1.0, 1.0), (2, 1, "CQ12T", "", 1.0, 1.0, 1.0), (None, 1, "CQ12T", "", 1.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame(told, ROW)
    proof = v.proven_rows(df, lines)
    assert {(r.doc_id, r.row_no): r.line_no for r in proof.collect()} == {(1, 1): 1, (1, 2): 2, (1, 3): 4, (1, 6): 1}
    assert proof.columns == ["doc_id", "row_no", "page", "line_no"] and v.proven_rows(df, lines.limit(0)).count() == 0

    c = F.col
    cases = [("CQ12T", "Digital mixer", True, 1.0), ("CQ12T", "Digital mixer", False, 1.0), ("CQ12T", "Digital mixer", True, 9.0), ("CQ12T", "Thing", True, 1.0), ("", "Thing", True, 1.0), ("", "Thing", False, 1.0), ("", "Thing", True, 9.0), ("", "Training", True, 1.0), ("CQ12T", "Mixer", None, 1.0)]
    j = v.judged(spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, sku string, item_name string, proven boolean, amount double"))
    j = j.withColumn("ok", econ_ok(F.lit(1.0), F.lit(1.0), c("amount"), "gate"))
    j = j.withColumn("gate", v.row_gate(c("refused"), c("equipment"), c("model_like"), c("proven"), c("ok")))
    assert [r.s for r in j.orderBy("i").select(c("gate.status").alias("s")).collect()] == ["verified", "review", "review", "candidate", "review", "reject", "reject", "reject", "review"]
    web = [("confirmed", "confirmed"), (None, "confirmed"), (None, None), (None, "unconfirmed"), (None, "unavailable")]
    w = j.where("i = 0").crossJoin(spark.createDataFrame([(k, *x) for k, x in enumerate(web)], "k int, match string, web string"))
    got = w.orderBy("k").select(v.full_gate(c("gate"), c("proven"), c("ok"), c("match"), c("web")).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [("verified", "web-confirmed", True), ("verified", "web-confirmed", False), ("pending", "mandatory-web-unavailable", False), ("pending", "mandatory-web-unconfirmed", False), ("pending", "mandatory-web-unavailable", False)]
    weak = j.where("i IN (1, 5)").orderBy("i").select(v.full_gate(c("gate"), c("proven"), c("ok"), F.lit("confirmed"), F.lit("confirmed")).alias("v")).select("v.bucket", "v.reason").collect()
    assert [tuple(r) for r in weak] == [("pending", "invoice-item-evidence-unproven"), ("rejected", "not-proven-as-line-item")]


def test_dispositions_and_analysis(spark):
    told = [
        (1, 1, "", "Projector", 1.0, 5.0, 5.0), (1, 2, "", "Projector", 1.0, 5.0, 9.0), (1, 3, "X1", "", 1.0, 5.0, 5.0), (2, 1, "", "Microphone stand", 1.0, 5.0, 5.0), (2, 2, "", "Wall bracket", 1.0, 5.0, 5.0),
        (2, 3, "", "Serial list", None, None, None), (2, 4, "", "Installation of projector", 1.0, 5.0, 5.0), (2, 5, "", "Extended warranty", 1.0, 5.0, 5.0),
    ]
    c = F.col
    d = spark.createDataFrame(told, ROW).withColumn("disposition", v.disposition(c("sku"), c("item_name"), c("quantity"), c("unit_price"), c("amount")))
    assert [r.disposition for r in d.orderBy("doc_id", "row_no").collect()] == ["equipment", "unknown", "equipment", "equipment", "accessory", "metadata", "service", "warranty"]
    given = spark.range(1).select(*(v.disposition(F.lit(""), F.lit("x"), F.lit(1), F.lit(1), F.lit(1), F.lit(g)).alias(f"g{i}") for i, g in enumerate(("Service", "noninventory", "odd", None)))).first()
    assert tuple(given) == ("service", "accessory", "unknown", "unknown")
    summary = v.ledger_summary(d)
    assert [(r.doc_id, r.detected, r.accounted, r.complete) for r in summary.orderBy("doc_id").collect()] == [(1, 3, 2, False), (2, 5, 5, True)]
    headers = spark.createDataFrame([(1, "A", "1", "2024-01-01"), (2, "A", "1", "2024-01-01"), (3, " ", None, None), (4, "A", "1", "2024-01-01")], "doc_id long, supplier_name string, invoice_number string, invoice_date string")
    missing = spark.createDataFrame([(4,), (4,)], "doc_id long")
    got = {r.doc_id: (r.issues, r.safe_to_promote) for r in v.analysis_gate(headers, summary, missing).collect()}
    assert got == {1: (["unaccounted-source-rows"], False), 2: ([], True), 3: (["supplier-not-proven", "invoice-number-not-proven", "invoice-date-not-proven"], False), 4: (["final-items-incomplete"], False)}


def test_two_readings_and_three_layers(spark):
    row = "struct<sku:string,quantity:double,unit_price:double,amount:double,serials:array<string>>"
    a = ("MX-1", 2.0, 5.0, 10.0, ["S1", "s2"])
    others = [("mx1", 2.0, 5.01, 10.0, ["S2", "S1"]), None, ("MX2", 3.0, None, 11.0, None), ("MX1", 2.0, 5.0, 10.0, ["S1"])]
    df = spark.createDataFrame([(i, a, b) for i, b in enumerate(others)], f"i int, a {row}, b {row}")
    got = v.three_layers(v.compare_readings(df), F.col("i") == 1).orderBy("i").collect()
    assert [r.disagreements for r in got] == [[], [], ["sku", "quantity", "unit_price", "amount", "serials"], ["serials"]]
    assert [(r.layer_two, r.human_review, r.core_verified) for r in got] == [("confirmed", False, True), ("unavailable", True, False), ("disagree", True, False), ("disagree", True, True)]
    assert [r.evidence.quantity for r in got] == ["confirmed", "confirmed", "uncertain", "confirmed"]
    assert got[2].row.sku is None and got[2].row.quantity == 2.0 and got[2].evidence.sku == "not_found" and got[3].evidence.serials == "not_found"
    assert got[1].reason == "unmatched" and got[3].reason == "differs:serials"
    assert got[2].choices.sku == ["MX-1", "MX2"] and got[2].choices.unit_price is None and got[2].choices.serials is None and got[3].choices.serials == ["S1, s2", "S1"]
    by_field = v.three_layers(v.compare_readings(df), {"sku": F.lit(True)}).orderBy("i").collect()[1].evidence
    assert (by_field.sku, by_field.quantity, by_field.serials) == ("confirmed", "uncertain", "uncertain")


READING = "doc_id long, no int, sku string, item_name string, quantity double, unit_price double, amount double, serials array<string>"


def test_readings_pair_greedily_in_order(spark):
    thing = ("MX-1", "Laser projector", 1.0, 5.0, 5.0, ["S1"])
    first = [(1, 1, *thing), (1, 2, *thing), (1, 3, "", "", None, None, None, None), (2, 1, *thing), (None, 1, *thing), (3, 1, "MX100A", "Camera", 2.0, None, None, [])]
    second = [(1, 1, "mx1", "projector LASER", 1.0, 5.0, 5.01, ["s1 "]), (1, 2, "MX1", "Laser projector", 9.0, 5.0, 5.0, ["S9"]), (1, 5, "ZZ", "Lamp", 7.0, 1.0, 7.0, []), (None, 1, *thing), (3, 1, "MX100", "Screen", 2.0, float("nan"), None, None)]
    got = v.pair_readings(spark.createDataFrame(first, READING), spark.createDataFrame(second, READING)).collect()
    assert sorted(((r.doc_id, r.no, r.second_no, r.score, r.status) for r in got), key=str) == sorted(
        [(1, 1, 1, 33.0, "matched"), (1, 2, 2, 13.0, "matched"), (1, 3, None, None, "missing"), (2, 1, None, None, "missing"), (None, 1, None, None, "missing"), (3, 1, 1, 11.0, "matched"),
         (1, None, 5, None, "unexpected"), (None, None, 1, None, "unexpected")], key=str)
    beside = v.independent_readings(spark.createDataFrame(first, READING), spark.createDataFrame(second, READING))
    seen = {(r.doc_id, r.no): r.b and r.b.sku for r in v.three_layers(v.compare_readings(beside), F.lit(False)).collect()}
    assert seen == {(1, 1): "mx1", (1, 2): "MX1", (1, 3): None, (2, 1): None, (None, 1): None, (3, 1): "MX100"}
    assert v.pair_readings(spark.createDataFrame([], READING), spark.createDataFrame(second, READING)).where("status <> 'unexpected'").count() == 0


def test_countercheck_of_documents(spark):
    rows = [(1, 1, "MX-12", None, "read"), (1, 2, "QX99", None, "read"), (1, 3, "T1", "date-metadata", "read"), (1, 4, "GONE5", None, "pending"), (2, 1, None, None, "read"), (None, 1, "ABC", None, None)]
    rows = spark.createDataFrame(rows, "doc_id long, row_no int, sku string, refused string, status string")
    lines = spark.createDataFrame([(1, 1, 1, "1 MX12 Laser"), (1, 1, 2, "QX 991 Lamp"), (4, 1, 1, "QX99")], "doc_id long, page int, line_no int, line string")
    anchors = [(1, i, True) for i in (1, 2, 3, 4, 4, 0)] + [(1, 5, False), (1, None, True), (2, 1, True), (2, 2, True), (2, 2, True), (3, 1, True)]
    got = v.countercheck(rows, lines, spark.createDataFrame(anchors, "doc_id long, ordinal int, strong boolean")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [(1, 3, "conflict", "refused:date-metadata"), (1, 2, "warning", "code-not-in-document"), (None, 1, "warning", "code-not-in-document"), (2, None, "warning", "numbered-rows-missing"), (3, None, "warning", "numbered-rows-missing")], key=str)
    assert v.countercheck(rows.drop("status").limit(0), lines, spark.createDataFrame([], "doc_id long, ordinal int, strong boolean")).count() == 0
    told = [("10RDSP-774", "10rdsp-774 mixer", 1, True), ("10RDSP-774", "x 10RDSP-774", 1, False), ("1", "1 mixer", 1, False), ("1-A", "1-A", 1, False), ("20RD", "20RD", 1, False), (None, "1", 1, False), ("12A", "12A x", 12, True)]
    df = spark.createDataFrame([t[:3] for t in told], "s string, l string, o int")
    assert [r[0] for r in df.select(v.fused_ordinal(F.col("s"), F.col("l"), F.col("o"))).collect()] == [t[3] for t in told]


def test_titles_of_pages(spark):
    told = [("Purchase Order No 4711\nqty amount total", "reject"), ("Purchase Order No: 4711\nqty amount total", "accept"), ("quote\nTax invoice", "reject"), ("Statement of facts", None), ("\n" * 90 + "BOQ", "reject"), ("x\n" * 80 + "BOQ", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(told)], "i int, t string").select("i", authority.page_marks("t").alias("m"))
    assert [r.m for r in df.orderBy("i").collect()] == [m for _, m in told]
