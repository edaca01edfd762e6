"""Codes and serials from further readings, table direction and numbers in words, on small tables by hand and against loops."""

import itertools
import random

from stockloom.operators import layout, witnesses

ROWS = "doc_id long, row_no int, sku string, item_name string, unit_price double, amount double"
SEEN = "doc_id long, page int, sku string, primary string, companion string, row_text string"


def test_codes_are_corrected_by_one_witness_alone(spark):
    text = "AB128 wall mounted projector 1 10.00 10.00 |"
    rows = [(i, 1, "AB-123", "wall mounted projector", 10.0, 10.0) for i in range(1, 9)] + [(9, 1, None, None, None, None)]
    seen = [
        (1, 1, "AB128", "AB 128  label", "AB128 - WT FOR x", text), (1, 1, "ab-128", "AB-128", "ABI28 - WARRANTY", text),  # twice the same, I like 1
        (2, 1, "AB128", "AB128", "AB128", text), (3, None, "AB128", "AB128", "AB128 - WT FOR x", text), (4, 1, "AB128", "AB128", "AB128 - WT FOR", text.replace("10.00 |", "11.00")),
        (5, 1, "AB128", "AB128", "AB128 - WT FOR", "AB128 chair 1 10.00 10.00"), (6, 1, "AB1238", "AB1238", "AB1238 - WT FOR", text), (7, 1, "AB123", "AB123", "AB123 - WT FOR", text), (8, 1, "AC128", "AC128", "AC128 - WT FOR", text),
        (9, 1, "AB128", "AB128", "AB128 - WT FOR", text), (9, 1, None, None, None, None),
    ]
    out = witnesses.correct_codes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(seen, SEEN))
    got = {r.doc_id: (r.sku, r.corrected_from) for r in out.collect()}
    assert got.pop(1) in {("AB128", "AB-123"), ("ab-128", "AB-123")}
    assert got == {**{i: ("AB-123", None) for i in range(2, 9)}, 9: (None, None)}


def test_serials_vote_as_lists(spark):
    rows = [(1, 1, "K9A", 2.0, []), (1, 2, "K8B", 1.0, ["X1"]), (1, 3, "K7C", 1.0, []), (1, 4, "K6D", 3.0, None), (1, 5, "", 1.0, [])]
    rows = spark.createDataFrame(rows, "doc_id long, row_no int, sku string, quantity double, serials array<string>")
    a = ["Mixer K9A 1.00 2.00", "note", "S/N: AB12, AB13", "Mixer K8B", "SN AB99", "Mixer K7C", "S/N AB55 x y", "Mixer K6D 1.00 1.00", "Mixer ZZ1 2.00 2.00", "S/N: LATE1"]
    b = ["Mixer K9A", "S/N : AB12, AB13", "Mixer K9A", "S/N: AB12", "Mixer K6D", "SN: NODIGIT"]
    lines = spark.createDataFrame([(1, s, i, t) for s, ls in ((1, a), (2, b)) for i, t in enumerate(ls)], "doc_id long, source int, n int, line string")
    got = {r.row_no: (r.serials, r.status, r.votes) for r in witnesses.serial_consensus(rows, witnesses.serial_readings(rows, lines)).collect()}
    assert got == {1: (["AB12", "AB13"], "bound", 2), 2: (["X1"], "conflict", 1), 3: ([], "weak", 1), 4: ([], "none", 0), 5: ([], "none", 0)}
    assert witnesses.serial_consensus(rows, witnesses.serial_readings(rows, lines.limit(0))).where("status <> 'none'").count() == 0


def direction(header, bands):
    """The rule as a loop."""
    import re

    total = lambda t: re.match(r"(?:sub\s*total|grand total|total|amount due|gst)\b", t.strip().lower()) is not None
    below = sorted(y for y, t in bands if total(t) and y > header)
    above = sorted((y for y, t in bands if total(t) and y < header), reverse=True)

    def side(inside):
        body = [t for y, t in bands if inside(y) and not total(t)]
        return 3 * sum(any(c.isdigit() for c in t) for t in body) + sum(any(c.isascii() and c.isalpha() for c in t) for t in body)

    if below and above:
        down, up = side(lambda y: header < y < below[0]), side(lambda y: above[0] < y < header)
        return (1 if down > up else -1) if down != up else 1 if below[0] - header <= header - above[0] else -1
    if below or above:
        return 1 if below else -1
    count = lambda ok: sum(ok(y) and any(c.isdigit() for c in t) for y, t in bands)
    return 1 if count(lambda y: y > header) >= count(lambda y: y < header) else -1


def test_table_direction_equals_a_loop(spark):
    rng = random.Random(4)
    pages = {p: [(float(rng.randint(0, 20)), rng.choice(["Sub Total 1", "totally 3", "words", "12", "a 3", ""])) for _ in range(rng.randint(0, 9))] for p in range(80)}
    bands = spark.createDataFrame([(p, y, t) for p, b in pages.items() for y, t in b] + [(1, None, "x 1")], "page long, y double, text string")
    heads = spark.createDataFrame([(p, h) for p in pages for h in (10.0, 5.0)], "page long, header_y double")
    got = {(r.page, r.header_y): r.direction for r in layout.table_direction(bands, heads).collect()}
    assert got == {(p, h): direction(h, b) for p, b in pages.items() for h in (10.0, 5.0)}


def test_numbers_in_words(spark):
    cols = (500.0, 610.0, 720.0)
    told = {
        1: ([("1", 492, 16), ("350.00", 585, 50), ("350.00", 695, 50)], (1.0, 350.0, 350.0)), 2: ([("1 350.00 350.00", 450, 320)], (1.0, 350.0, 350.0)), 3: ([("1 90.00", 455, 210), ("90.00", 698, 45)], (1.0, 90.0, 90.0)),
        4: ([("2 1,414.00 2,828.00", 450, 320)], (2.0, 1414.0, 2828.0)), 5: ([("1.35", 585, 45), ("0", 710, 12)], None), 6: ([("5000", 490, 30), ("804.00", 590, 48), ("804.00", 700, 48)], None),
        7: ([("1", 492, 16), ("350.00", 590, 48), ("0.00", 700, 42)], None), 8: ([], None), 9: ([(None, None, None)], None),
    }
    words = spark.createDataFrame([(k, t, float(x) if x is not None else None, float(w) if w is not None else None) for k, (ws, _) in told.items() for t, x, w in ws], "row_no int, text string, x double, width double")
    columns = spark.createDataFrame([(k, *cols) for k in told] + [(10, 3.0, 2.0, 1.0)], "row_no int, quantity_x double, price_x double, amount_x double")
    got = {r.row_no: (r.quantity, r.unit_price, r.amount) for r in layout.numbers_by_column(words, columns, ["row_no"]).collect()}
    assert got == {k: v for k, (_, v) in told.items() if v}


def test_numbers_in_words_equal_a_loop(spark):
    rng = random.Random(6)
    cols, spacing = (100.0, 150.0, 220.0), 50.0
    rows = {k: [(str(rng.choice([1, 2, 3, 6, "2.00", "3.00", "6.00"])), float(rng.randint(60, 250)), 10.0) for _ in range(rng.randint(2, 7))] for k in range(60)}

    def best(words):
        seen = {(f"{x}|{t}", float(t), x + 5, "." in t) for t, x, w in words}
        near = lambda c, ok: [(i, v, abs(at - c), d) for i, v, at, d in seen if abs(at - c) <= max(18, 0.72 * spacing) and ok(v)]
        found = [
            (1000 - (q[2] + p[2] + a[2]) / spacing * 80 + 12 * p[3] + 12 * a[3], -q[1], -p[1], -a[1])
            for q, p, a in itertools.product(near(cols[0], lambda v: v == int(v) and 1 <= v <= 999), near(cols[1], lambda v: True), near(cols[2], lambda v: True))
            if len({q[0], p[0], a[0]}) == 3 and abs(q[1] * p[1] - a[1]) <= max(0.03, 0.003 * a[1])
        ]
        return tuple(-x for x in max(found)[1:]) if found else None

    words = spark.createDataFrame([(k, *w) for k, ws in rows.items() for w in ws], "row_no int, text string, x double, width double")
    columns = spark.createDataFrame([(k, *cols) for k in rows], "row_no int, quantity_x double, price_x double, amount_x double")
    got = {r.row_no: (r.quantity, r.unit_price, r.amount) for r in layout.numbers_by_column(words, columns, ["row_no"]).collect()}
    want = {k: best(ws) for k, ws in rows.items()}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 5


def test_codes_by_votes_of_readings(spark):
    name = "Laser projector bright"
    rows = [(i, 1, "AB-1", name) for i in range(1, 9)] + [(9, 1, None, name), (9, 2, "AB-1", None), (None, 1, "AB-1", name)]
    seen = [
        (1, 1, 1, "ac-2", "bright laser PROJECTOR"), (1, 2, 1, "AC2", name),  # two against one, spelled as first read
        (2, 1, 1, "AC2", name), (3, 1, 1, "AC2", name), (3, 2, 1, "AD3", name), (4, 1, 1, "AC2", name), (4, 2, 1, "AC2", name), (4, 3, 1, "AB1", name),  # one, two different, a tie
        (5, 1, 1, "AC2", "Laser lamp black"), (5, 2, 1, "AC2", "Laser lamp black"), (6, 1, 2, "AC2", name), (6, 1, 1, "AD3", name), (6, 2, 1, "AD3", name),  # not alike; the first of equals
        (7, 1, 1, "AC2", "Laser projector for the system"), (7, 2, 1, "AC2", name), (7, None, 1, "AD3", name), (8, 1, 1, "", name), (8, 2, 1, None, name),
        (9, 1, 1, "AC2", name), (9, 2, 1, "AC2", name), (None, 1, 1, "AC2", name), (None, 2, 1, "AC2", name),
    ]
    out = witnesses.identity_consensus(spark.createDataFrame(rows, "doc_id long, row_no int, sku string, item_name string"), spark.createDataFrame(seen, "doc_id long, source int, no int, sku string, item_name string")).collect()
    got = {(r.doc_id, r.row_no): (r.sku, r.replaced, r.votes) for r in out}
    assert len(out) == len(rows) and got[1, 1] == ("ac-2", "AB-1", 2) and got[6, 1] == ("AD3", "AB-1", 2) and got[7, 1] == ("AC2", "AB-1", 2) and got[9, 1] == ("AC2", "", 2)
    assert {k for k, x in got.items() if x[1] is None} == {(2, 1), (3, 1), (4, 1), (5, 1), (8, 1), (9, 2), (None, 1)} and got[8, 1][2] == 1


def test_no_line_is_copied_to_those_above_it_and_a_code_of_one_word_joins_no_words(spark):
    """Seven lines were gathered for every line, and all runs of a line's words were joined for every code that it holds."""
    rows = spark.createDataFrame([(1, 1, "MX-12"), (1, 2, "AB 3"), (1, 3, "X1")], "doc_id long, row_no int, sku string")
    seen = [(1, "a", 1, "projector MX 12 here"), (1, "a", 2, "S/N: Q1"), (1, "a", 3, "speaker AB3"), (1, "a", 4, "camera X1 1.00 2.00"), (1, "a", 5, "x"), (1, "a", 6, "x"), (1, "a", 7, "x"), (1, "a", 8, "x"), (1, "a", 9, "x"), (1, "a", 10, "SN: Q2")]
    df = witnesses.serial_readings(rows, spark.createDataFrame(seen, "doc_id long, source string, n int, line string"))
    assert sorted((r.row_no, r.serials) for r in df.collect()) == [(1, ["Q1"]), (3, ["Q2"])]  # a priced line stands between the second and its label
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, currentrow$(), 6" not in plan and "Contains(apart" in plan


def test_a_print_is_read_once(spark):
    """Filters repeated what the columns beside them compute: each companion was matched against its pattern four times."""
    rows = spark.createDataFrame([(1, 1, "MX12", "lamp", 1.0, 1.0)], "doc_id long, row_no int, sku string, item_name string, unit_price double, amount double")
    seen = spark.createDataFrame([(1, 1, "MZ12", "MZ12", "MZ12 - WT FOR 1", "lamp 1.00 1.00")], "doc_id long, page int, sku string, primary string, companion string, row_text string")
    plan = witnesses.correct_codes(rows, seen)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WT\\s+FOR") == 1
