"""Classifiers: held-out accuracy on the supplied tables, and edge cases."""

import os

import numpy as np
import pytest

from stockloom.llm import language_id, quality_classifier, toxicity

SF = "/root/testdata/sf0.1"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 ?!", "en", "a", 5), (4, "x" * 300_000, "de", "a", 1), (4, "x" * 300_000, "de", "a", 1), (None, "the the", "en", "a", 1)]
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")


def crc_fold(ids, n):
    import zlib

    return np.array([zlib.crc32(str(i).encode()) % n for i in ids])


@needs_data
def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out.to_numpy() == (crc_fold(got.doc_id, 5) == 0)).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and held.score.between(0, 1).all()


@needs_data
def test_toxicity_of_held_out_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.06
    assert ((held.score >= 0.5).astype(int) == held.predicted).all()


@needs_data
def test_quality_of_held_out_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_classifier.quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out.to_numpy() == (crc_fold(got.doc_id, 3) == 1)).all()
    held = got[got.held_out]
    assert held[held.quality == 1].predicted.mean() > 0.9 and held[held.quality == 0].predicted.mean() < 0.12
    assert held.score.nunique() > 500  # the order of texts is kept, not only their side


def test_quality_scores_keep_the_order_of_differences():
    d = np.array([-0.3, -0.2, -0.2, -0.1, 0.0, 0.1, 0.15, 0.3])
    for y in ([0, 0, 0, 0, 1, 1, 1, 1], [0, 1, 0, 0, 1, 0, 1, 1]):
        m = quality_classifier.Model(b"", b"", *quality_classifier._calibrate(d, np.array(y)))
        p = 1 / (1 + np.exp(-(m.slope * d + m.level)))
        assert (np.diff(p)[np.diff(d) > 0] > 0).all() and p[0] < 0.5 < p[-1] and np.isfinite(p).all()
    assert quality_classifier._calibrate(d, np.array([1, 1, 1, 1, 0, 0, 0, 0])) == (0.0, 0.0)


def test_models_take_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ODD], DOC + ", score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (3, 0, 0), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for make in (lambda d, y: language_id.identify(d), toxicity.toxicity, quality_classifier.quality):
        got = make(docs, labels).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert make(docs.limit(0), labels).count() == 0 and len(make(docs, labels.limit(0)).collect()) == len(ODD)
    und = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert und[1] == und[2] == und[3] == "und"


def test_numbers_that_look_like_letters_name_no_language(spark):
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 10 + [("\u00bd", None), ("\u00b2\u00b3", None), ("\u2167", None), ("12 \u00bd a", None), ("\u4eca\u5929", None)])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert [got[i] for i in (20, 21, 22)] == ["und"] * 3 and got[23] != "und" and got[24] != "und"


def test_svm_families_and_pairs():
    families = {language_id.family(x) for x in ("en", "de-AT", "fr", "es", "xx")}
    assert families == {"germanic", "romance", "only:xx"}


def test_grams_do_not_cross_texts():
    m = toxicity.train(["you idiot you"] * 12 + ["a fine day"] * 12, np.array([1] * 12 + [0] * 12))
    assert m.score(["you idi", "ot you"])[0] == m.score(["you idi"])[0]
    assert m.score(["you idiot"])[0] > 0.5 > m.score(["a fine day"])[0]


def test_toxicity_sees_characters_of_any_script():
    bad, fine = ["你这个笨蛋 走开", "sh1t happens", "f*ck that", "ты дурак"], ["今天天气很好", "ship happens", "back that", "ты дома"]
    order = np.random.default_rng(0).permutation(64)  # every fourth text calibrates only
    m = toxicity.train([(bad * 8 + fine * 8)[i] for i in order], (order < 32).astype(int))
    assert (m.score(bad) > 0.5).all() and (m.score(fine) < 0.5).all()
