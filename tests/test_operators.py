"""Operators on small literal tables: the acceptance scenario, negative cases and invariants."""

import datetime
import math
import os
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockloom.operators import audit, authority, consensus, gates, health, ledger, matching, resolve, stock
from stockloom.sources import readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def items(spark):
    return spark.createDataFrame([(1, "A1", "Lamp", "x"), (2, "B2", "Mixer", None), (3, "C3", "Screen", "y")], "id long, sku string, item_name string, category string")


def summary(spark):
    bought = spark.createDataFrame([(1, Decimal(2)), (1, Decimal(3)), (2, Decimal(1))], "item_id long, quantity decimal(14,2)")
    gone = spark.createDataFrame([(1, Decimal(1)), (2, Decimal(4))], "item_id long, quantity decimal(14,2)")
    return stock.inventory_summary(items(spark), bought, gone)


def test_acceptance_scenario(spark):
    got = rows(summary(spark).select("id", "purchased", "adjusted", "current"))
    assert got == [(1, 5, 1, 4), (2, 1, 4, -3), (3, 0, 0, 0)]
    counted = spark.createDataFrame([(1, 4), (2, 0)], "item_id long, physical int")
    assert [r.status for r in stock.stock_take(summary(spark), counted).orderBy("id").collect()] == ["Match", "Over", "Not counted"]
    wanted = spark.createDataFrame([(1, 4), (1, 5), (9, 1)], "item_id long, quantity int")
    assert rows(stock.adjustment_allowed(summary(spark), wanted).select("item_id", "quantity", "allowed")) == [(1, 4, True), (1, 5, False), (9, 1, False)]


def test_health_rules_and_score(spark):
    serials = spark.createDataFrame([(1, "S1"), (2, "s1 ")], "item_id long, serial string")
    purchases = spark.createDataFrame([(7, None), (8, datetime.date(2024, 1, 1))], "id long, day date")
    docs, lines = spark.createDataFrame([(7,), (8,)], "id long"), spark.createDataFrame([(8,)], "purchase_id long")
    found = health.all_findings(summary(spark), serials, purchases, docs, lines, spark.createDataFrame([(3,)], "id long"))
    assert {r.issue_type for r in found.collect()} == set(health.RULES) - {"Serial review"}
    assert health.score(found).first().score == 100 - 12 * 3 - 7 * 3 and health.score(found.limit(0)).first().label == "Excellent"
    keys = [r.issue_key for r in found.orderBy("issue_key").collect()]
    reviews = spark.createDataFrame([(keys[0], "resolved"), (keys[1], None), ("gone:x:1", None)], "issue_key string, resolution_status string")
    left = health.open_findings(found, reviews).collect()
    assert len(left) == len(keys) - 1 and [r.reviewed for r in left if r.issue_key == keys[1]] == [True]
    assert rows(health.history(reviews, found).select("status")) == [("resolved",), ("still-detected",), ("still-detected",)]


def test_orphans_and_contents(spark):
    kids, parents = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(1,)], "id long")
    assert health.orphans(kids, "k", parents, "id", "x").first().n == 1 and health.orphans(kids, "k", parents, "id", "x", True).first().n == 2
    docs = spark.createDataFrame([(1, None, None), (2, "a", None), (3, "b", "00"), (4, "c", "AB"), (5, "d", "ab"), (6, "zz", "ab")], "id long, storage_path string, file_sha256 string")
    blobs = spark.createDataFrame([("a", "5", "ab"), ("b", "5", "ab"), ("c", "5", "ab"), ("d", "n/a", "ab")], "name string, size string, sha256 string")
    assert [r.outcome for r in health.verify_contents(docs, blobs).orderBy("id").collect()] == ["no-path", "no-hash", "bad-hash", "verified", "empty", "missing"]
    ages = spark.createDataFrame([(1.0,), (36.0,), (60.0,), (61.0,), (None,)], "h double")
    assert [r.s for r in ages.select(health.backup_status(F.col("h")).alias("s")).collect()] == ["PASS", "PASS", "WARN", "FAIL", "UNKNOWN"]
    assert ages.limit(3).select(health.backup_status(F.col("h")).alias("status")).agg(health.worst().alias("w")).first().w == "WARN"


def test_matching_against_the_catalogue(spark):
    cat = spark.createDataFrame([(1, "AB-1", "Wall Lamp"), (2, "CD-2", "Desk Lamp"), (3, "CD-3", "Desk Lamp"), (4, "none", "Stand")], "id long, sku string, item_name string")
    lines = spark.createDataFrame([(1, "ab1", "x"), (2, "", "wall lamp"), (3, "", "desk lamp"), (4, "ZZ9", "Wall Lamp"), (5, None, None), (6, "", "Stand"), (7, "", "Chair")], "line_id long, sku string, item_name string")
    got = {r.line_id: (r.reason, r.item_id) for r in resolve.match_exact_or_name(lines, cat).collect()}
    assert got == {
        1: ("exact-sku", 1), 2: ("same-name-single-verified-model", 1), 3: ("conflicting-existing-models", None), 4: ("incoming-model-conflict", None),
        5: ("no-identity", None), 6: ("same-normalized-name", 4), 7: ("no-existing-match", None),
    }
    top = resolve.fuzzy_top(lines.where("line_id = 4").withColumn("sku", F.lit("CD-Z")), cat).orderBy("rank").collect()
    assert top[0].rank == 1 and top[0].item_id == 2 and top[0].status == "confirmed" and [r.item_id for r in top] == [2, 3, 1]
    none = resolve.fuzzy_top(lines.where("line_id = 5"), cat).collect()
    assert [(r.line_id, r.rank, r.item_id, r.status) for r in none] == [(5, 1, None, "rejected")]


def _plain_top(lines, items, keep=3):
    """All items scored for every line, one by one."""
    from stockloom.functions.similarity import STOP_WORDS, _distance

    bare = lambda x: re.sub("[^A-Z0-9]+", "", (x or "").upper())
    words = lambda x: {w for w in re.sub("[^a-z0-9]+", " ", (x or "").lower()).split() if len(w) >= 3 and w not in STOP_WORDS}
    once = {}
    for j, other, title in sorted(items):
        if bare(other):
            once.setdefault(bare(other), (j, words(title)))
    out = {}
    for i, sku, name in lines:
        k, own, scored = bare(sku), words(name), []
        for other, (j, title) in once.items() if k else ():
            near = len(own & title) / max(len(own), len(title)) if own and title else 0.0
            like = max(0.0, 1 - round(_distance(k, other) * 20) / 20 / max(len(k), len(other)))
            scored.append((-(100.0 if k == other else math.floor(min(100.0, like * 85 + near * 12) * 10 + 0.5) / 10), j))
        out[i] = [(n + 1, j, -x) for n, (x, j) in enumerate(sorted(scored)[:keep])] or [(1, None, None)]
    return out


def _fuzzy(spark, lines, items):
    got = {}
    lines, items = spark.createDataFrame(lines, "line_id long, sku string, item_name string"), spark.createDataFrame(items, "id long, sku string, item_name string")
    for r in resolve.fuzzy_top(lines, items).collect():
        got.setdefault(r.line_id, []).append((r.rank, r.item_id, r.score))
    return {i: sorted(x) for i, x in got.items()}


@pytest.mark.parametrize("blocks", [(4096, 16384), (11, 90)])
def test_fuzzy_matches_equal_brute_force(spark, monkeypatch, blocks):
    from stockloom.operators import nearest

    monkeypatch.setattr(nearest, "ASKED", blocks[0])
    monkeypatch.setattr(nearest, "ITEMS", blocks[1])
    rng = random.Random(3)
    sku = lambda low, high: "".join(rng.choice("AB01O8IZ2G6-") for _ in range(rng.randint(low, high)))
    items = [(i, sku(3, 14), rng.choice(["Wall Lamp", "Desk Lamp", "Stand for the Desk", "Ceiling Mount Arm", None])) for i in range(400)]
    lines = [(i, sku(0, 14), rng.choice(["Wall Lamp", "wall lmp", "", "arm of ceiling", None])) for i in range(60)]
    lines += [(100 + i, x, y) for i, (_, x, y) in enumerate(rng.sample(items, 20))] + [(200, None, "Wall Lamp"), (201, "A" * 3000, "Desk Lamp")]
    assert _fuzzy(spark, lines, items) == _plain_top(lines, items)


def test_fuzzy_matches_edges(spark):
    assert _fuzzy(spark, [(1, "ABCD1234EF", "Wall Lamp")], [(5, "ABCD12XYEF", "Wall Lamp")]) == {1: [(1, 5, 80.0)]}  # two edits, an equal name
    assert _fuzzy(spark, [(1, "ab-1", "x"), (2, "", "x")], []) == {1: [(1, None, None)], 2: [(1, None, None)]}
    assert _fuzzy(spark, [], [(5, "A1", "x")]) == {}
    copies = [(9, "AB-1", "Lamp"), (7, "ab1", "Other"), (8, "AB2", "Lamp"), (6, None, "Lamp")]  # one sku counts once, the smallest id
    assert _fuzzy(spark, [(1, "AB1", "Lamp"), (2, "AB1", "Lamp")], copies) == {i: [(1, 7, 100.0), (2, 8, round(85 * 2 / 3 + 12, 1))] for i in (1, 2)}
    far = resolve.fuzzy_top(spark.createDataFrame([(1, "AB1", "x")], "line_id long, sku string, item_name string"), spark.createDataFrame([(3, "AB2", "x"), (2, "QQ7", "x")], "id long, sku string, item_name string"))
    assert [(r.item_id, r.score, r.margin, r.status) for r in far.orderBy("rank").collect()] == [(3, 56.7, 56.7, "rejected"), (2, 0.0, 0.0, "rejected")]


def test_look_alikes_equal_brute_force(spark):
    rng = random.Random(5)
    names = [" ".join(rng.choice(["steel", "wall", "lamp", "desk", "red", "old", "x"]) for _ in range(rng.randint(0, 6))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(names)), "id long, item_name string")
    got = {r.id: (r.n_links, r.first_id) for r in resolve.linked_items(df).collect()}
    sets = [{w for w in n.split() if len(w) >= 2} for n in names]
    for i, a in enumerate(sets):
        near = [j for j, b in enumerate(sets) if j != i and a and b and len(a & b) / max(len(a), len(b)) >= 0.72]
        assert got[i] == (len(near), min([i, *near]))
    members, pairs = resolve.look_alikes(df)
    assert members.count() == 150 and pairs.where("class_a = class_b").count() == 0


def test_duplicates_and_merge(spark):
    it = spark.createDataFrame([(1, "A-1", "Lamp", 2), (2, "a1", "LAMP", 1), (3, "B2", "lamp", 3), (4, "Q", "Solo", 1)], "id long, sku string, item_name string, created int")
    got = {r.id: (r.action, r.canonical_id, r.review) for r in resolve.duplicate_policy(it).collect()}
    assert got == {1: ("merge", 2, True), 2: ("keep", 2, True), 3: (None, None, True)}
    lines = spark.createDataFrame([(1, 5), (3, 7), (None, 1)], "item_id long, q int")
    after = resolve.remap(lines, "item_id", resolve.duplicate_policy(it).where("action = 'merge'"))
    assert sorted((r.item_id or 0, r.q) for r in after.collect()) == [(0, 1), (2, 5), (3, 7)]
    assert resolve.assert_same_totals(lines, after, "q").first().checked
    with pytest.raises(Exception, match="merge changed totals"):
        resolve.assert_same_totals(lines, after.where("q <> 7"), "q").collect()
    plan = resolve.linked_items(it)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_votes_stay_blank_on_ties(spark):
    r = spark.createDataFrame([(1, "a", "s1"), (1, "a", "s2"), (1, "b", "s3"), (2, "a", "s1"), (2, "b", "s2"), (3, "a", "s1"), (3, "a", "s1"), (4, None, "s1")], "doc long, v string, src string")
    got = {x.doc: (x.value, x.status) for x in ledger.vote(r, ["doc"], "v", "src").collect()}
    assert got == {1: ("a", "resolved"), 2: (None, "tie"), 3: (None, "weak")}
    c = spark.createDataFrame([(1, "x", 120.0, "a"), (1, "y", 95.0, "b"), (2, "x", 100.0, "a"), (2, "y", 95.0, "b"), (3, "x", 50.0, "a")], "doc long, value string, score double, source string")
    assert {x.doc: (x.value, x.status) for x in ledger.choose_header(c, ["doc"]).collect()} == {1: ("x", "resolved"), 2: (None, "conflicting-evidence"), 3: (None, "insufficient-evidence")}


def test_ledger_counts_repeats(spark):
    r = spark.createDataFrame([("a", "k", 1, 5), ("a", "k", 2, 9), ("b", "k", 1, 7), ("b", "", 2, 1)], "origin string, key string, no int, strength int")
    assert rows(ledger.ledger(r, "key", "origin", "no", "strength")) == [("k", 1, 2, 1, 7), ("k", 2, 1, 2, 9)]
    assert ledger.dedupe_exact(r, "key", "origin", "no").count() == 2
    gaps = spark.createDataFrame([(1, 1, 1), (1, 2, None), (1, 3, None), (1, 4, 4), (1, 5, None), (1, 6, 9), (1, 7, None)], "doc long, pos int, ordinal int")
    assert [x.filled for x in ledger.fill_gaps(gaps, "doc", "pos", "ordinal").orderBy("pos").collect()] == [1, 2, 3, 4, None, 9, None]
    b = spark.createDataFrame([(1, 2, None, "q"), (1, 1, "p", None)], "doc long, rank int, u string, w string")
    assert rows(ledger.backfill(b, "doc", [F.asc("rank")], ["u", "w"])) == [(1, "p", "q")]


CANDIDATES = "doc_id long, origin string, ordinal int, sku string, item_name string, quantity double, unit_price double, amount double, non_inventory boolean"


def test_verdicts(spark):
    good = lambda d, o: [(d, o, 1, "A1", "Lamp", 2.0, 10.0, 20.0, False), (d, o, 2, "B2", "Mixer", 1.0, 5.0, 5.0, False)]
    r = [*good(1, "x"), *good(1, "y"), (2, "x", 1, "A1", "Lamp", 2.0, 10.0, 30.0, False), (3, "x", 1, "", "Installation", 1.0, 9.0, 9.0, True), (4, "x", 1, "A1", "Serial no 5", 1.0, 9.0, 9.0, False)]
    sub = spark.createDataFrame([(1, 25.0)], "doc_id long, subtotal double")
    df = spark.createDataFrame(r, CANDIDATES)
    got = {v.doc_id: (v.status, v.winner, v.reasons) for v in consensus.verdicts(df, sub).collect()}
    assert got[1] == ("review", "x", "low-confidence")  # twins leave no margin
    assert got[2][2].startswith("economic-mismatch") and got[3][2].startswith("structural-review") and got[4][2].startswith("structural-review")
    alone = df.where("NOT (doc_id = 1 AND origin = 'y' AND ordinal = 1)")
    best = {v.doc_id: v for v in consensus.verdicts(alone, sub).collect()}[1]
    assert best.status == "accepted" and best.confidence >= 0.72 and best.margin > 0


def test_page_authority(spark):
    pages = [(1, 1, "TAX INVOICE\nqty amount total"), (1, 2, "more lines"), (1, 3, "Purchase Order\nqty unit price total"), (1, 4, "more"), (2, 1, "lines only"), (2, 2, "Invoice\nPurchase order ref: 7")]
    df = spark.createDataFrame(pages, "doc long, page int, text string").withColumn("mark", authority.page_marks("text"))
    assert [r.allowed for r in authority.page_authority(df, "doc", "page", "mark").orderBy("doc", "page").collect()] == [True, True, False, False, False, True]
    names = ["Mic stand", "Supply and install projector", "Installation of projector", "Wall mount bracket", "Projector 4k", "Extended warranty", "Chair", None]
    got = spark.createDataFrame([(n,) for n in names], "t string").transform(authority.line_classes, "t", "c").collect()
    assert [r.c for r in got] == ["equipment", "equipment", "service", "accessory", "equipment", "warranty", "uncertain", "uncertain"]
    content = spark.createDataFrame([(1, "service", False), (1, "x", True), (2, "service", False), (3, "x", False), (4, "noninventory", True)], "doc_id long, class string, strong boolean")
    assert dict(rows(authority.content_authority(content))) == {1: "equipment", 2: "service", 3: "uncertain", 4: "noninventory"}


def events(spark):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    e = [(1, t(0), 7, "purchase"), (2, t(8), 7, "line"), (3, t(8.001), 7, "line"), (4, t(1), 8, "line"), (5, t(-8), 7, "line"), (6, t(4), 7, "purchase")]
    return spark.createDataFrame(e, "event_id long, ts timestamp, user_id long, event_type string")


def test_audit_windows(spark):
    got = {r.event_id: r.n_hidden for r in audit.consolidate(events(spark), "purchase", "line", 8).collect()}
    assert got == {1: 1, 4: None, 6: 2}
    assert rows(audit.sessions(events(spark), 4).select("user_id", "n_events")) == [(7, 1), (7, 4), (8, 1)]
    j = spark.createDataFrame([(1, '{"a":"1","b":"2","updated_at":"x"}', '{"a":"1","b":"3","c":"4","updated_at":"y"}'), (2, None, '{"a":"5"}')], "id long, o string, n string")
    assert rows(audit.change_summary(j, "id", "o", "n").na.fill("-")) == [(1, "b", "2", "3"), (1, "c", "-", "4"), (2, "a", "-", "5")]


def test_gates(spark):
    lines = spark.createDataFrame([(1, 1, "Lamp", 2.0, 5.0, 10.0), (2, 1, "Lamp", 0.0, 5.0, 0.0), (3, 1, " ", 1.0, None, 5.0), (4, 1, "Lamp", 1.0, 5.0, 5.07)], "doc_id long, line_no int, item_name string, quantity double, unit_price double, amount double")
    serials = spark.createDataFrame([(1, 1, "s1"), (4, 1, "S1 ")], "doc_id long, line_no int, serial string")
    bad = gates.save_violations(lines, serials)
    assert rows(bad.select("doc_id", "violation")) == [(1, "duplicate-serial"), (2, "quantity"), (3, "economics-missing"), (3, "item-name"), (4, "duplicate-serial"), (4, "economics-mismatch")]
    assert rows(gates.publishable(lines, gates.save_violations(lines)).select("doc_id")) == [(1,)]
    batch = spark.createDataFrame([("Acme Ltd", "sku", "a", "b"), ("ACME", "sku", "a", "b"), ("Acme", "sku", "a", "a"), ("Acme", "note", "a", "b"), ("Bolt", "sku", "c", "d")], "supplier string, field_name string, source_value string, corrected_value string")
    known = spark.createDataFrame([("bolt", "sku", "c", "d", "approved")], "supplier_key string, field_name string, source_value string, corrected_value string, status string")
    assert rows(gates.new_corrections(batch, known, ("sku",))) == [("acme", "sku", "a", "b")]
    old = spark.createDataFrame([("a", {"x": "1", "y": "2"}, 3, 10, 20)], "supplier_key string, labels map<string,string>, sample_count long, first_seen int, last_seen int")
    seen = spark.createDataFrame([("a", {"y": "9"}, 30), ("b", {"z": "1"}, 5)], "supplier_key string, labels map<string,string>, seen_at int")
    got = {r.supplier_key: (r.labels, r.sample_count, r.first_seen, r.last_seen) for r in gates.upsert_profiles(old, seen).collect()}
    assert got == {"a": ({"x": "1", "y": "9"}, 4, 10, 30), "b": ({"z": "1"}, 1, 5, 5)}


def test_greedy_matches_keep_counts(spark):
    r = [(1, "primary", 1, "A", "red lamp", 1.0, 2.0, 2.0), (1, "primary", 2, "A", "red lamp", 1.0, 2.0, 2.0), (1, "secondary", 1, "A", "red lamp", 1.0, 2.0, 2.0), (1, "secondary", 2, "Z", "chair", 9.0, 9.0, 81.0)]
    df = spark.createDataFrame(r, "doc_id long, side string, no int, sku string, name string, quantity double, unit_price double, amount double")
    got = rows(matching.greedy_matches(df).select("status"))
    assert got == [("matched",), ("missing",), ("unexpected",)]


def test_bands_cells_and_triples(spark):
    words = [(1, "b", 50.0, 10.4, 10.0, 5.0), (1, "a", 10.0, 10.0, 10.0, 5.0), (1, "c", 10.0, 30.0, 10.0, 5.0)]
    w = spark.createDataFrame(words, "page long, text string, x double, y double, height double, width double")
    cols = spark.createDataFrame([(1, "name", 0.0, 30.0), (1, "qty", 30.0, 90.0)], "page long, name string, lo double, hi double")
    assert rows(matching.assign_cells(w, cols).select("text", "name")) == [("a", "name"), ("b", "qty"), ("c", "name")]
    t = spark.createDataFrame([(1, 1, float(i), v) for i, v in enumerate((7.0, 2.0, 5.0, 10.0))] + [(1, 2, 1.0, 3.0)], "page long, row int, x double, value double")
    assert rows(matching.numeric_triples(t).select("quantity", "unit_price", "amount")) == [(2.0, 5.0, 10.0)]


def test_readers(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "s.json").write_text('{"items": [{"id": 1}, {"id": 2}], "docs": []}')
    store = readers.read_json_store(spark, str(tmp_path / "s.json"), {n: T.StructType.fromDDL("id long") for n in ("items", "docs")})
    assert store["items"].count() == 2 and store["docs"].count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "f.bin").write_bytes(b"abc")
    blob = readers.read_blobs(spark, str(tmp_path / "b")).first()
    assert (blob["name"], blob["size"], blob["sha256"][:8]) == ("f.bin", 3, "ba7816bf")
    (tmp_path / "w.tsv").write_text("level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t3\t4\t5\t6\t90\tHi\n4\t1\t1\t1\t1\t1\t3\t4\t5\t6\t90\tno\n")
    assert rows(readers.read_word_tsv(spark, str(tmp_path / "w.tsv")).select("text", "x")) == [("Hi", 3.0)]
    hocr = spark.createDataFrame([(1, "<span class='ocrx_word' id='w' title='bbox 1 2 11 22; x_wconf 91'>Yo</span>")], "page int, markup string")
    assert rows(readers.words_of_hocr(hocr)) == [(1, "Yo", 1.0, 2.0, 10.0, 20.0, 91.0)]
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Hello</w:t></w:p><w:p><w:t>You</w:t></w:p></w:document>')
    (tmp_path / "bad.docx").write_bytes(b"nope")
    assert sorted((r.text or "", r.error or "") for r in readers.read_docx(spark, str(tmp_path)).collect()) == [("", "BadZipFile"), ("Hello\nYou", "")]
    kinds = spark.createDataFrame([("a.PDF", None), ("b", "image/png"), ("c.docx", ""), ("d.xyz", None)], "n string, m string").select(readers.file_kind("n", "m").alias("k"))
    assert [r.k for r in kinds.collect()] == ["pdf", "image", "docx", "unsupported"]


def test_lines_and_sessions(spark):
    from stockloom.operators import parsers

    page = "Invoice\nDescription Qty Unit Price Amount\nAB-12 Wall lamp 2 10.00 20.00\nwith long arm\nS/N: X1, X2\n14\n1| Chair 5.00 5.00\nSub Total 25.00\nCD-9 Ghost 1 9.00 9.00\fDescription Qty Price\nEF-3 Desk I 7.50 7.50"
    df = spark.createDataFrame([(1, page), (2, None), (3, "nothing here")], "doc_id long, text string")
    got = {(r.page, r.row_no): r for r in parsers.parse_pages(df).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)}
    a = got[1, 1]
    assert (a.sku, a.item_name, a.quantity, a.unit_price, a.amount, a.description, a.serials) == ("AB-12", "Wall lamp", 2.0, 10.0, 20.0, "Wall lamp with long arm", ["X1", "X2"])
    assert (got[1, 2].sku, got[1, 2].item_name, got[1, 2].quantity) == (None, "Chair", 1.0) and got[2, 1].quantity == 1.0
    blocks = parsers.blocks_by_ordinal(spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(["head", "1. a", "more", "7 not next", "2. b"])], "doc_id long, page int, line_no int, line string"))
    assert rows(blocks) == [(1, 1, "1. a more 7 not next"), (1, 2, "2. b")]
    parts = [spark.createDataFrame([(1, i, v) for i, v in enumerate(vs)], f"doc_id long, ordinal int, {n} string") for n, vs in (("code", "ab"), ("name", "cd"), ("price", "ef"))]
    assert rows(parsers.zip_columns(*parts)) == [(1, 1, "a", "c", "e"), (1, 2, "b", "d", "f")]
    assert parsers.zip_columns(parts[0], parts[1], parts[2].limit(1)).count() == 0


def test_row_guards(spark):
    from stockloom.operators import parsers

    spec = spark.createDataFrame([("Lamp 5500 lumens", 5500.0), ("Lamp 5500 lumens", 2.0), ("Tube 1.5 m 15 w", 15.0), (None, 1.0)], "n string, q double")
    assert [r.s for r in spec.select(parsers.quantity_is_specification("n", "q").alias("s")).collect()] == [True, False, True, False]
    r = spark.createDataFrame([(1, 1, "equipment", ["a"], 1.0, "MX1"), (1, 2, "warranty", ["b", "MX1"], 1.0, ""), (2, 1, "warranty", ["c"], 1.0, "")], "doc_id long, row_no int, class string, serials array<string>, quantity double, item_name string")
    moved = {(x.doc_id, x.row_no): x.serials for x in parsers.move_warranty_serials(r).collect()}
    assert moved == {(1, 1): ["a", "b", "MX1"], (1, 2): [], (2, 1): ["c"]}
    cleaned = {(x.doc_id, x.row_no): x.serials for x in parsers.serials_that_are_models(r).collect()}
    assert cleaned[1, 2] == ["b"]
    lines = spark.createDataFrame([(1, "x 2.00 3.00 12.00"), (2, "x 5.00"), (3, "y 7.00 7.00")], "doc_id long, line string")
    assert {x.doc_id: (x.quantity, x.amount) for x in parsers.direct_candidates(lines, ["doc_id"]).collect()} == {1: (4.0, 12.0), 2: (None, None), 3: (1.0, 7.0)}


def test_cells_vote_by_group(spark):
    from stockloom.operators import evidence

    def cell(doc, field, text, group, dpi=300, scope="cell"):
        return doc, field, text, group, dpi, scope

    r = [cell(1, "quantity", "2", "a"), cell(1, "unit_price", "5.00", "a"), cell(1, "amount", "10.00", "a"), cell(1, "amount", "11.00", "b")]
    r += [cell(2, "quantity", "2", "a"), cell(2, "quantity", "3", "b"), cell(2, "unit_price", "5.00", "a"), cell(2, "amount", "10.00", "a"), cell(2, "amount", "15.00", "b")]
    r += [cell(3, "quantity", "2", "a", 200), cell(3, "unit_price", "5.00", "a"), cell(3, "amount", "10.00", "a")]
    r += [*r[4:9], cell(4, "quantity", "2", "a")]
    df = spark.createDataFrame(r, "doc_id long, field string, text string, evidence_group string, render_dpi int, scope string")
    assert {x.doc_id: (x.quantity, x.status) for x in evidence.resolve_cells(df, ["doc_id"]).collect()} == {1: (2.0, "resolved"), 2: (None, "ambiguous"), 3: (None, "unsupported"), 4: (None, "unsupported")}


def test_web_and_documents(spark):
    from stockloom.operators import evidence

    res = [(1, "Sure SM58 mic", "", "https://www.sure.com/sm58"), (2, "Sure SM58", "", "https://shop-a.test/x"), (2, "sure sm-58", "", "https://shop-b.test/x"), (3, "Sure SM58", "", "https://www.ebay.com/x"), (3, "SM57", "", "https://a.test")]
    cand = [(i, "Sure", "SM58", ["mic"]) for i in (1, 2, 3)]
    scored = evidence.web_scores(spark.createDataFrame(res, "candidate_id long, title string, snippet string, url string"), spark.createDataFrame(cand, "candidate_id long, brand string, model string, words array<string>"))
    assert {x.candidate_id: (x.status, x.domains) for x in evidence.web_verdicts(scored).collect()} == {1: ("confirmed", 1), 2: ("confirmed", 2), 3: ("unconfirmed", 0)}
    d = spark.createDataFrame([(10.0, None, 10.7), (10.0, None, 9.0), (None, 0.7, 10.7), (10.0, 0.7, 11.0)], "s double, t double, g double")
    got = [x.m for x in d.select(evidence.document_money(F.col("s"), F.col("t"), F.col("g")).alias("m")).collect()]
    assert [(m.tax, m.adds_up) for m in got] == [(0.7, True), (None, False), (0.7, True), (0.7, False)] and got[2].subtotal == 10.0
    v = spark.createDataFrame([(1, "name", "red wall lamp"), (1, "x", "blue chair")], "doc_id long, field string, value string")
    ln = spark.createDataFrame([(1, 1, 1, "a Red wall-lamp"), (1, 1, 2, "blue")], "doc_id long, page int, line_no int, line string")
    assert {x.field: (round(x.coverage, 2), x.supported) for x in evidence.coverage(v, ln).collect()} == {"name": (1.0, True), "x": (0.5, False)}
    m = evidence.recall_metrics(v.select("field"), v.select("field").limit(1), ["field"]).first()
    assert (m.expected, m.found, m.both, m.recall) == (2, 1, 1, 0.5)
    t = spark.createDataFrame([(1, "Wall-Lamp", "a"), (1, "WALL LAMP", "b"), (1, "Chair", "c")], "doc_id long, name string, src string")
    assert evidence.shortest_popular(t, ["doc_id"], "name", "src").first().votes == 2


def test_saving_and_deleting(spark):
    from stockloom.sources import sinks

    masters = spark.createDataFrame([(1, "AB-1", "Lamp"), (2, "", "Desk")], "id long, sku string, item_name string")
    lines = spark.createDataFrame([(1, 1, "ab1", "x", 1, ["s1"]), (1, 2, "", "desk", 1, [" "]), (1, 3, "N9", "New", 1, []), (2, 1, "n-9", "New!", 1, [])], "doc_id long, line_no int, sku string, item_name string, quantity int, serials array<string>")
    lines = lines.withColumns({"unit_price": F.lit(1.0), "amount": F.lit(1.0)})
    plan = sinks.save_plan(masters, lines, lines)
    assert [r.item for r in plan["lines"].orderBy("doc_id", "line_no").collect()] == ["1", "2", "new:sku:N9", "new:sku:N9"]
    assert rows(plan["new_items"]) == [("sku:N9", "N9", "New")] and rows(plan["serials"]) == [(1, 1, "s1")]
    inc = spark.createDataFrame([("Acme ", "IN1"), ("Bolt", "IN2")], "supplier_name string, invoice_number string")
    assert sinks.duplicate_invoices(inc, spark.createDataFrame([("ACME", "in1")], inc.schema)).count() == 1
    names = spark.createDataFrame([(1, "a.pdf"), (2, "A.pdf"), (3, "b")], "id int, name string")
    assert [r.unique_name for r in sinks.unique_names(names, "name", "id").orderBy("id").collect()] == ["a.pdf", "A-2.pdf", "b"]
    doc = sinks.invoice_documents(lines.withColumnRenamed("doc_id", "purchase_id"), spark.createDataFrame([(1, "Acme", None)], "id long, supplier_name string, invoice_number string")).first()
    assert doc.missing == ["invoice_number"] and len(doc.lines) == 3


def test_contained_texts_anywhere_in_a_line(spark):
    from stockloom.operators import evidence

    words = "red lamp on the old oak table near door".split()
    docs = [(1, "we saw a red lamp on the old oak table near door nine"), (2, "red lamp on the"), (3, "a shared lamp on thermal pads, old\n"), (4, None), (None, "colour red lamp on the old oak table near doors"), (1, "x"), (5, "")]
    needles = [(1, " ".join(words)), (2, "red lamp on the"), (3, "lamp"), (4, "red lamp on"), (5, "old\n"), (6, None), (7, "red  lamp on the"), (8, "lamp on")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(needles, "item_id long, text string")
    want = {(i, k) for i, n in needles for k, t in docs if n is not None and t is not None and n in t}
    for few in (100_000, 0):
        got = [tuple(r) for r in evidence.contained_texts(d, b, few).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert evidence.contained_texts(d, b.limit(0)).count() == 0


def test_every_order_line_has_a_sku_status(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("no tables here")
    got = entry.queries()["unique_sku_consolidation"](spark, sf).agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def greedy_by_hand(table):
    words = lambda s: {w for w in (s or "").lower().split() if len(w) > 2}

    def points(a, b):
        x, y = words(a[4]), words(b[4])
        out = 3.0 * len(x & y) / max(len(x), len(y)) if x and y else 0.0
        out += 6.0 if a[3] and a[3] == b[3] else 0.0
        for c, weight in ((5, 1.0), (6, 2.0), (7, 2.0)):
            if a[c] is not None and b[c] is not None:
                out += weight if abs(a[c] - b[c]) <= 0.01 else -weight
        return out

    out = []
    for doc in {r[0] for r in table}:
        first, free = (sorted((r for r in table if r[0] == doc and r[1] == s), key=lambda r: r[2]) for s in ("primary", "secondary"))
        for a in first:
            best = max(((points(a, b), -i) for i, b in enumerate(free)), default=(-1.0, 0))
            if best[0] >= 6.0:
                out.append((doc, a[2], free.pop(-best[1])[2], round(best[0], 6), "matched"))
            else:
                out.append((doc, a[2], None, None, "missing"))
        out += [(doc, None, b[2], None, "unexpected") for b in free]
    return sorted(out, key=repr)


def test_greedy_matches_equal_brute_force(spark):
    import random

    rnd = random.Random(7)
    table = []
    for doc in range(1, 21):
        for side in ("primary", "secondary"):
            for no in range(rnd.randint(0, 9)):
                name = rnd.choice([None, "", " ".join(rnd.sample(["red", "oak", "lamp", "desk", "of", "stand"], 3))])
                economics = [rnd.choice([None, 1.0, 1.005, 1.01, 2.0, 9.99, 10.0]) for _ in range(3)]
                table.append((doc, side, no, rnd.choice([None, "", "A", "B", "C"]), name, *economics))
    df = spark.createDataFrame(table, "doc_id long, side string, no int, sku string, name string, quantity double, unit_price double, amount double")
    got = sorted(((r[0], r[1], r[2], None if r[3] is None else round(r[3], 6), r[4]) for r in matching.greedy_matches(df).collect()), key=repr)
    assert got == greedy_by_hand(table)
    assert any(r[4] == "matched" for r in got)


def test_greedy_match_covers_all_documents(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("no tables here")
    got = entry.queries()["greedy_match"](spark, sf).agg(F.count("primary_no"), F.count("secondary_no")).first()
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert tuple(got) == (li.where("l_returnflag = 'N'").count(), li.where("l_returnflag <> 'N'").count())


def test_evidence_lines_hold_whole_words(spark):
    from stockloom.operators import parsers

    docs = spark.createDataFrame([(1, "MX123 lamp\nold MX-12 lamp\nMX 12 again"), (2, "AB 34 CD\nplain")], "doc_id long, text string")
    values = spark.createDataFrame([(1, "sku", "MX12"), (1, "sku", "MX123"), (1, "sku", "MX1"), (2, "sku", "AB-34"), (2, "sku", "ab34cd"), (2, "sku", "34C"), (2, "sku", "--")], "doc_id long, field string, value string")
    got = {(r.doc_id, r.value): r.line_no for r in parsers.evidence_lines(values, parsers.lines_of(docs)).collect()}
    base = min(x for x in got.values() if x is not None)
    assert {k: None if x is None else x - base for k, x in got.items()} == {(1, "MX12"): 1, (1, "MX123"): 0, (1, "MX1"): None, (2, "AB-34"): 0, (2, "ab34cd"): 0, (2, "34C"): None, (2, "--"): None}


def test_key_listing_and_serial_cascade_are_whole(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no tables here")
    got = [r.issue_key for r in entry.queries()["issue_keys"](spark, sf).collect()]
    assert len(got) == spark.read.parquet(f"{sf}/supplier.parquet").count() > 50 and got == sorted(got)
    n = {r.name: r.n for r in entry.queries()["delete_cascade"](spark, sf).collect()}
    assert 0 < n["serials"] == n["lines"] < spark.read.parquet(f"{sf}/lineitem.parquet").count()
