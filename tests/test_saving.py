"""Mending what is known, merging items, saving all or nothing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stockloom.operators import matching, stock
from stockloom.sources import publish

ROW = "doc_id long, no int, sku string, item_name string, quantity double, unit_price double, amount double, serials array<string>"


def plain_merge(known, read):
    """The rules as loops over one document."""
    bare = lambda x: re.sub("[^A-Z0-9]", "", (x or "").upper())
    words = lambda x: {w for w in re.split("[^a-z0-9]+", (x or "").lower()) if len(w) >= 3}
    copies = lambda rows, k: sum(bare(r["sku"]) == k for r in rows)

    def score(i, a, j, b):
        u, v = bare(a["sku"]), bare(b["sku"])
        su, sv = re.sub("[A-Z]$", "", u), re.sub("[A-Z]$", "", v)
        s = 0.0 if not u or not v else 8.0 if u == v else 5.0 if len(su) >= 5 and (su == v or sv == u or su == sv) else 0.0
        x, y = words(a["item_name"]), words(b["item_name"])
        s += 5.0 * (1.0 if not x and not y else 0.0 if not x or not y else len(x & y) / max(len(x), len(y)))
        e = 0.0
        for c, same, other in (("quantity", 6, -8), ("unit_price", 3, -3), ("amount", 5, -5)):
            if a[c] is not None and b[c] is not None:
                e += same if abs(a[c] - b[c]) < 0.02 else other
        s += e + (6.0 if set(a["serials"] or []) & set(b["serials"] or []) else 0.0)
        return s + (e * 1.5 - 0.35 * abs(i - j) if u and u == v and copies(read, v) > 1 else 0.0)

    used, out = set(), {}
    for i, a in enumerate(known):
        best = max(((score(i, a, j, b), -j) for j, b in enumerate(read) if j not in used), default=(0, 0))
        if best[0] >= 5:
            used.add(-best[1])
            out[a["no"]] = read[-best[1]]["no"]
    return out, {b["no"] for j, b in enumerate(read) if j not in used and b["verified"]}


def test_merge_equals_plain_loops(spark):
    rng = random.Random(12)

    def rows(d, side):
        return [
            dict(doc_id=d, no=n, sku=rng.choice(["", None, "ABC12", "ABC12X", "Z9"]), item_name=rng.choice(["wall lamp", "wall lamp red", "desk", "", None]), quantity=rng.choice([None, 1.0, 2.0]), unit_price=rng.choice([None, 5.0, 6.0]), amount=rng.choice([None, 5.0, 12.0]), serials=rng.choice([[], None, ["S1"], ["S1", "S2", "S3"]]))
            | ({"verified": rng.choice([True, False, None])} if side else {})
            for n in range(1, rng.randint(1, 7))
        ]

    docs = {d: (rows(d, 0), rows(d, 1)) for d in range(40)}
    known, read = ([tuple(r.values()) for x in docs.values() for r in x[s]] for s in (0, 1))
    out = matching.merge_readings(spark.createDataFrame(known, ROW), spark.createDataFrame(read, ROW + ", verified boolean")).collect()
    for d, (one, two) in docs.items():
        mine, (want, free) = [r for r in out if r.doc_id == d], plain_merge(one, two)
        assert {r.no: r.read_no for r in mine if r.status == "mended"} == want
        assert {r.read_no for r in mine if r.status == "added"} == free
        assert {r.no for r in mine if r.status != "added"} == {r["no"] for r in one}
        for r in mine:
            if r.status == "mended":
                a, b = next(x for x in one if x["no"] == r.no), next(x for x in two if x["no"] == r.read_no)
                for c in ("unit_price", "amount"):
                    assert r[c] == (b[c] if b["verified"] and b[c] is not None else a[c])
                assert (r.sku or None) == (a["sku"] or b["sku"] or None)


def test_merge_impact_names_its_blockers(spark):
    lines = spark.createDataFrame([(1, 5.0), (1, 1.0), (2, 2.0), (4, 1.0)], "item_id long, quantity double")
    off = spark.createDataFrame([(2, 9.0), (4, 1.0)], "item_id long, quantity double")
    serials = spark.createDataFrame([(1, "a1"), (2, "A1 "), (2, ""), (4, None), (4, "x")], "item_id long, serial string")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 4), (3, 3), (5, 4)], "a long, b long")
    got = {(r.from_id, r.to_id): r for r in stock.merge_impact(pairs, lines, off, serials).collect()}
    assert set(got) == {(1, 2), (2, 1), (1, 4), (4, 1), (4, 5), (5, 4)}
    assert (got[1, 2].lines_moved, got[1, 2].serials_moved, got[1, 2].stock_after, got[1, 2].blockers) == (2, 1, -1.0, ["shared-serials", "negative-stock"])
    assert got[2, 1].adjustments_moved == 1 and got[4, 1].blockers == [] and (got[5, 4].lines_moved, got[5, 4].stock_from) == (0, 0)


LINES = "doc_id long, amount double"


def books(spark, root):
    return sorted(tuple(r) for r in publish.saved(spark, root, "lines", LINES).collect()), sorted(tuple(r) for r in publish.saved(spark, root, "serials", "doc_id long, serial string").collect())


def test_saving_is_all_or_nothing_and_once(spark, tmp_path):
    root = f"file://{tmp_path}/books"
    lines = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 7.0)], LINES)
    serials = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, serial string")
    assert books(spark, root) == ([], [])
    assert publish.publish(root, {"lines": lines, "serials": serials})
    first = books(spark, root)
    assert first == ([(1, 5.0), (1, 5.0), (2, 7.0)], [(1, "a"), (2, None)])
    assert publish.publish(root, {"lines": lines.orderBy(F.desc("amount")), "serials": serials}) is None

    bad = spark.createDataFrame([(1, 9.0), (3, -1.0)], LINES).withColumn("amount", F.when(F.col("amount") < 0, F.raise_error(F.lit("negative")).cast("double")).otherwise(F.col("amount")))
    with pytest.raises(Exception, match="negative"):
        publish.publish(root, {"lines": bad, "serials": serials})
    assert books(spark, root) == first

    def dies(batches):  # the task that writes the second table is killed
        import os

        for b in batches:
            os.kill(os.getpid(), 9)
            yield b

    new = spark.createDataFrame([(1, 9.0), (3, 1.0)], LINES)
    marked = spark.createDataFrame([(3, "c")], "doc_id long, serial string")
    with pytest.raises(Exception):  # noqa: B017
        publish.publish(root, {"lines": new, "serials": marked.mapInArrow(dies, marked.schema)})
    assert books(spark, root) == first
    assert publish.publish(root, {"lines": new, "serials": marked})
    assert books(spark, root) == ([(1, 9.0), (2, 7.0), (3, 1.0)], [(2, None), (3, "c")])


def test_a_batch_that_failed_between_its_tables_is_never_read(spark, tmp_path):
    root = f"file://{tmp_path}/books"
    lines, serials = spark.createDataFrame([(1, 5.0)], LINES), spark.createDataFrame([(1, "a")], "doc_id long, serial string")
    late = serials.withColumn("serial", F.when(F.rand() >= 0, F.raise_error(F.lit("late"))).otherwise(F.col("serial")))
    with pytest.raises(Exception):  # noqa: B017
        publish.publish(root, {"lines": lines, "serials": late})
    assert books(spark, root) == ([], [])
    lines.write.parquet(f"{root}/lines/batch=left-over")
    assert books(spark, root) == ([], [])
