"""The pipeline: contracts between stages, and a small corpus worked by hand."""

import random

import corpus_pipeline
from stockloom.llm import queries


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "ré", "st"]) for _ in range(rng.randint(1, 4)))
    para = lambda n: " ".join(word() for _ in range(n))
    passage = para(80)
    docs = [(i, para(60), "en", f"s{i % 3}", 0) for i in range(40)]
    docs += [(100, docs[3][1], "en", "s0", 0), (101, "too short", "en", "s1", 0), (102, None, "en", "s1", 0), (103, "spam " * 50, "en", "s1", 0)]
    docs += [(110, para(30) + " " + passage, "fr", "s2", 0), (111, para(30) + " " + passage + " " + para(10), None, None, 0)]
    return docs, passage


def test_stages(spark, tmp_path):
    docs, passage = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path)
    spark.createDataFrame(docs, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        if name != "byte_bpe":
            assert out.columns == now.columns and [t for _, t in out.dtypes] == [t for _, t in now.dtypes]
        out.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        seen[name] = now.collect()
    ids = lambda name: sorted({r.doc_id for r in seen[name]})
    assert ids("quality_rules") == [*range(40), 100, 110, 111]
    assert ids("simhash_near_dedup") == [*range(40), 110, 111]
    text = {r.doc_id: r.text for r in seen["suffix_array_dedup"]}
    assert passage in text[110] and passage[1:-1] not in text[111] and text[5] == docs[5][1]
    assert all(r.n_chars == len(r.text) for r in seen["suffix_array_dedup"] if r.doc_id == 111)
    assert len(seen["mixing"]) >= len(set(ids("mixing"))) and set(ids("mixing")) <= set(ids("suffix_array_dedup"))
    assert len(seen["byte_bpe"]) == len(seen["mixing"]) and all(r.n_tokens > 0 for r in seen["byte_bpe"])
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == sorted(tuple(r) for r in seen["byte_bpe"])


def test_registry():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "mixing", "byte_bpe"]
