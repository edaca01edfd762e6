"""Rows of a document stay in its task: after the first shuffle by document no query shuffles them by document and something else."""

import os
import re

import pytest

import __spark_entry__ as entry
from stockloom.operators import matching
from stockloom.operators import verification as v
from stockloom.operators.nearest import blocks
from stockloom.operators.parsers import word_runs
from stockloom.plans import saving
from stockloom.plans import verification as plans
from stockloom.sources.cut import spread

SF = "/root/testdata/sf0.001"
#: Finding and query.
QUERIES = {
    "F1": "code_witness_correction", "F2": "countercheck", "F3": "evidence_line_lookup", "F4": "fragment_consolidation", "F5": "full_gate", "F6": "identity_consensus", "F8": "source_proof_gate",
    "F9": "witness_consolidation", "F10": "best_raw_region", "F11": "recovery_union", "F13": "targeted_recovery", "F14": "serial_consensus", "F24": "greedy_match",
}


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
@pytest.mark.parametrize("name", QUERIES.values(), ids=QUERIES.keys())
def test_no_shuffle_but_by_document(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = [[re.sub(r"#\d+L?", "", k) for k in x.split(", ")[:-1]] for x in re.findall(r"Exchange hashpartitioning\(([^()]*)\)", plan)]
    assert keys
    assert [k for k in keys if len(k) > 1] == []


def test_only_runs_that_are_wanted(spark):
    lines = spark.createDataFrame([(1, 1, 0, "MX 12-B lamp of nine words that nobody asks for"), (1, 1, 1, "MX123 lamp"), (2, 1, 0, "MX12B")], "doc_id long, page int, line_no int, line string")
    wanted = spark.createDataFrame([(1, "MX12B"), (1, "MX12"), (1, ""), (2, "LAMP")], "doc_id long, k string")
    got = sorted((r.doc_id, r.line_no, r.k) for r in word_runs(lines, wanted).collect())
    assert got == [(1, 0, "MX12"), (1, 0, "MX12B")]


def test_tasks_follow_the_table(spark):
    """F15 to F26: at any size of the table a task unfolds as few rows, and a document is in one task."""
    df = spark.range(1000).selectExpr("id % 50 AS doc_id", "id")
    parts = spread(df, df, "doc_id", 20)
    assert parts.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 51)
    places = parts.selectExpr("doc_id", "spark_partition_id() AS p").distinct()
    assert places.count() == 50


def test_patterns_by_first_letter_match_the_same(spark):
    """words gathered by their letter; patterns of another form, or with a first letter that may be missing, stay."""
    texts = ["laser projector", "projectors.", "subprojector", "pre amplifier", "e-mail: x", "email", "p/o no 7", "pte. ltd.", "co reg", "page 12", "lampkits", "mic stand", "video  processors", "services", "re instatement", "a.c adapter", "", "x"]
    for p in (v.EQUIPMENT, v.SERVICE, v.SERVICE_ACTION, v.SERVICE_SKU, v.SERVICE_START, v.ACCESSORY, v.WARRANTY, v.HEADER_WORDS, v.COMPANY, v.ADDRESS, v.DATE_LABEL, v.ASSET, v.NOTE):
        low = p.lower()
        said = [x for w in low.split("|") for x in (re.sub(r"[^a-z ]", "", w), re.sub(r"\(\?:.*|\W+$", "", w) + " 1")]
        assert [bool(re.search(low, t)) for t in texts + said] == [bool(re.search(v.by_letter(low), t)) for t in texts + said]
    assert v.by_letter(v.EQUIPMENT).startswith(r"\b(?=[") and v.by_letter(r"\b(?:x?y|z)\b") == r"\b(?:x?y|z)\b" and v.by_letter(r"\b(?:a)(?:b)\b") == r"\b(?:a)(?:b)\b"


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["reading_pairs", "three_layer_verification"])
def test_pairs_are_scored_once(spark, name):
    """the rows of two readings meet in one join, not once for each use of what is chosen."""
    entry.queries()[name](spark, SF)
    first, second = plans._two_readings(spark, SF)
    out = matching.pair_readings(first, second) if name == "reading_pairs" else v.independent_readings(first, second)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"aggregate\(", plan)) == 1


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["ledger_with_occurrence", "ledger_vs_final"])
def test_ledger_rows_stay_with_their_key(spark, name):
    """rows of a key are numbered and counted in its task, of which there are as many as the table needs."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = {re.sub(r"#\d+L?", "", x).rpartition(", ")[0] for x in re.findall(r"Exchange hashpartitioning\(([^()]*)\)", plan)}
    assert keys == {"row_key"}


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
def test_lines_are_joined_once_for_all_publications(spark, monkeypatch):
    """what is published is read from a cut, not joined again for each digest and table."""
    seen = []
    monkeypatch.setattr(saving.publish, "publish", lambda root, tables: seen.extend(tables.values()))
    monkeypatch.setattr(saving.publish, "saved", lambda spark, root, name, schema: spark.createDataFrame([], schema))
    entry.queries()["published_invoices"](spark, SF)
    assert len(seen) == 6 and not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in seen)


def test_copies_of_blocks_follow_the_size(spark):
    """at 60 times sf0.1 an item was written 1,172 times, once for each block of asked skus."""
    assert blocks(1_200_000, 1_200_000, 12) == (74, 74)
    assert blocks(20_000, 20_000, 8) == (12, 2)
    assert blocks(0, 0, 8) == (1, 1)


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["fragment_consolidation", "witness_consolidation", "best_raw_region"], ids=["F4", "F9", "F10"])
def test_order_lines_travel_once(spark, name):
    """Rows are laid together by document; what is compared, followed and chosen inside it is shuffled no more, and nothing is written on the way."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    sent = re.findall(r"Exchange hashpartitioning\(([^()]*)\)[^\n]*\n\W*(\w+ [^\n]*)", re.sub(r"#\d+L?", "", plan))
    assert len(sent) == plan.count("Exchange hashpartitioning") and len(set(sent)) == 1 and "InArrow" not in plan  # equal ones are one
