"""Keys, tolerances, similarities and text columns with literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from stockloom.functions import economics, keys, similarity, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("none")])
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (keys.clean, " a  b\t c ", "a b c"), (keys.clean, None, ""), (keys.norm, "Mic-Stand  (No. 2)", "mic stand no 2"), (keys.compact, "ab-12/c", "AB12C"),
        (keys.supplier_key, "Acme Pte. Ltd.", "acme"), (keys.supplier_key, "Cobalt Co", "cobalt"), (keys.ocr_skeleton, "iLos-8b", "110588"), (keys.normalized_item_identity, "Supply of the Lamp 12 mm", "of lamp"),
        (keys.standard_item_name_key, "Ｐro & Co", "pro and co"), (keys.brand_key, "Remaco Pte Ltd", "REMACO"), (keys.brand_key, "Rode", "RODE"), (keys.present, "  ", None), (keys.slug, "Missing category", "missing-category"),
    ],
)
def test_keys(spark, function, value, want):
    assert one(spark, function(F.lit(value).cast("string"))) == want


def test_composed_keys(spark):
    assert one(spark, keys.canonical_identity(F.lit("Sure"), F.lit("sm-58"))) == "SURE::SM58"
    assert one(spark, keys.canonical_identity(F.lit("Sure"), F.lit(""))) is None
    assert one(spark, keys.evidence_identity_key(F.lit("A 1"), F.lit("x"))) == "sku:a1"
    assert one(spark, keys.evidence_identity_key(F.lit(None).cast("string"), F.lit("Supply the lamp"))) == "name:lamp"
    row = keys.row_ledger_key(F.lit(None).cast("string"), F.lit(""), F.lit("Lamp"), F.lit(2.0), F.lit(1.5), F.lit(None).cast("double"))
    assert one(spark, row) == "desc:lamp|q:2.00|p:1.50|a:"
    assert one(spark, keys.health_issue_key(F.lit("Serial review"), F.lit("master_items"), F.lit("A7"))) == "serial-review:master_items:a7"
    assert one(spark, keys.standard_file_name(F.lit("2024-01-02"), F.lit("Acme Pte Ltd"), F.lit("IN/7"))) == "2024-01-02_Acme_IN-7.pdf"
    assert one(spark, keys.line_signature(F.lit(""), F.lit(""), F.lit(1), F.lit(1), F.lit(1), F.lit(None))) == ""


def test_tolerances_differ(spark):
    q, p, a = F.lit(3.0), F.lit(10.0), F.lit(30.05)
    ok = {n: one(spark, economics.econ_ok(q, p, a, n)) for n in economics.PROFILES}
    assert ok["gate"] and ok["evidence"] and not ok["strict"] and ok["save"] and not ok["line_audit"]
    assert one(spark, economics.econ_ok(F.lit(0.0), p, F.lit(0.0))) is False
    assert one(spark, economics.econ_ok(F.lit(None).cast("double"), p, a)) is False
    assert one(spark, economics.half_up_2(F.lit(1.005))) == 1.0 and one(spark, economics.half_up_2(F.lit(-2.5))) == -2.5
    third = one(spark, economics.third_of_three(F.lit(None).cast("double"), F.lit(2.5), F.lit(10.0)))
    assert third.quantity == 4.0
    assert one(spark, economics.derived_quantity(F.lit(3.0), F.lit(10.0))) is None


def test_five_similarities(spark):
    s = lambda a, b, m: one(spark, similarity.similarity(F.lit(a), F.lit(b), m))
    assert s("", "", "p7") == 1.0 and s("", "", "catalogue") == 0.0 and s("", "abc", "p7") == 0.0
    assert s("red lamp", "red lamp shade", "catalogue") == pytest.approx(2 / 3) and s("the lamp set", "lamp", "gate") == 1.0
    assert s("wall lamps", "wall lamps extra words", "f15") == 1.0 and s("red wall", "red", "v3") == 0.0
    assert one(spark, similarity.sku_similarity(F.lit("MX-10O"), F.lit("MX100"))) == pytest.approx(1 - 0.15 / 5)
    assert one(spark, similarity.sku_similarity(F.lit(""), F.lit("A1"))) == 0.0
    assert one(spark, similarity.within_one_edit(F.lit("TAXINV0ICE"), F.lit("TAXINVOICE"))) is True


def test_text(spark):
    for raw, want in (("S$1,234.50", 1234.5), ("12,50", 12.5), ("SGD 7", 7.0), ("none", None), (None, None)):
        assert one(spark, text.money(F.lit(raw).cast("string"))) == want
    assert [one(spark, text.quantity(F.lit(x))) for x in ("I", "2 pcs", "0", "x")] == [1.0, 2.0, None, None]
    assert one(spark, text.money_tokens(F.lit("a $1,200.00 b 3.50"))) == ["$1,200.00", "3.50"]
    assert one(spark, text.serial_tokens(F.lit("sn AB12CD34, 12345678 ABCDEFGH ab12cd34"))) == ["AB12CD34"]
    days = [one(spark, text.parse_day_first(F.lit(x))) for x in ("31/12/2023", "1.2.71", "1-2-24", "31/02/2024", "2024-05-06", "x")]
    assert days == [datetime.date(2023, 12, 31), datetime.date(1971, 2, 1), datetime.date(2024, 2, 1), None, datetime.date(2024, 5, 6), None]
    assert one(spark, text.labelled_value(F.lit("a\nInvoice No: X-1 \nb"), "invoice no")) == "X-1"
    assert [one(spark, text.confidence_band(F.lit(x))) for x in (0.96, 0.8, 0.1)] == ["high", "medium", "low"]
    assert one(spark, text.local_day(F.lit("2024-01-01 20:00:00").cast("timestamp"))) == datetime.date(2024, 1, 2)
    assert one(spark, text.invoice_signals(F.lit("Invoice No 1\nQty Unit price Amount\nTotal GST"))) == 7
