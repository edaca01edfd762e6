"""Positioned words to rows, with a page that must give none."""

from stockloom.operators import layout

SCHEMA = "page long, text string, x double, y double, width double, height double"


def page(number, lines):
    return [(number, t, float(x), y + (i % 2) * 0.8, 8.0 * len(t), 10.0) for y, row in lines for i, (x, t) in enumerate(row)]


def words(spark):
    head = (10.0, [(0, "Code"), (100, "Description"), (300, "Qty"), (400, "Price"), (500, "Amount")])
    one = [head, (30.0, [(0, "AB-1"), (100, "Wall"), (140, "lamp"), (300, "2"), (400, "5.00"), (500, "10.00")]), (45.0, [(100, "with"), (140, "arm")]),
           (60.0, [(0, "CD-2"), (100, "Chair"), (300, "3"), (500, "21.00")]), (75.0, [(0, "EF-3"), (100, "Desk"), (300, "2"), (400, "5.00"), (500, "99.00")]), (90.0, [(400, "Sub"), (440, "Total"), (500, "31.00")]),
           (105.0, [(100, "Ghost"), (300, "1"), (500, "9.00")])]
    two = [(10.0, [(0, "Dear"), (60, "Sir")]), (30.0, [(0, "7"), (300, "9.00")])]
    return spark.createDataFrame(page(1, one) + page(2, two), SCHEMA)


def test_rows_of_a_table(spark):
    got = {r.row_no: (r.sku, r.item_name, r.quantity, r.unit_price, r.amount, r.verified) for r in layout.table_rows(words(spark)).where("page = 1").collect()}
    assert got == {1: ("AB-1", "Wall lamp with arm", 2.0, 5.0, 10.0, True), 2: ("CD-2", "Chair", 3.0, 7.0, 21.0, True), 3: ("EF-3", "Desk", None, None, None, False)}
    assert layout.table_rows(words(spark)).where("page = 2").count() == 0


def test_bands_and_columns(spark):
    banded = layout.band_words(words(spark))
    text = {(r.page, r.band): r.text for r in layout.band_text(banded).collect()}
    assert text[1, 0] == "Code Description Qty Price Amount" and text[1, 2] == "with arm" and text[2, 1] == "7 9.00"
    cols = {r.name: (r.lo, r.hi) for r in layout.header_columns(banded).collect()}
    assert list(sorted(cols)) == ["amount", "description", "quantity", "sku", "unit_price"] and cols["sku"][0] == float("-inf") and cols["quantity"][1] == cols["unit_price"][0]
    clusters = layout.column_clusters(words(spark).where("page = 1")).collect()
    assert sum(r.n for r in clusters) == words(spark).where("page = 1").count() and len(clusters) >= 5
