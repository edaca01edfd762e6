"""Suffix dedup, encoding, HTML, quality rules and mixing against brute force and exact round trips."""

import base64
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import bpe, html_extract, mixing, quality_rules, suffix_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_removed(rows, n):
    seen, out = set(), []
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - n + 1):
            if raw[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(raw[p : p + n])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed, n_docs=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "ré", "st", "ü"]) for _ in range(rng.randint(1, 4)))
    para = lambda n: " ".join(word() for _ in range(n))
    shared = [para(rng.randint(15, 60)) for _ in range(5)]
    rows = []
    for i in range(n_docs):
        t = para(rng.randint(0, 50))
        for _ in range(rng.randint(0, 3)):
            t += " " + rng.choice(shared) + " " + para(rng.randint(0, 20))
        if i % 11 == 0:
            t = "Again " * rng.randint(5, 80)
        if i % 17 == 0 and i:
            t = rows[i - 5][1]
        rows.append((i, t))
    return [*rows, (900, None), (901, ""), (902, "a" * 3000), (903, "a" * 99), (904, "a" * 100)]


@pytest.mark.parametrize(("n", "kw"), [(100, {}), (30, {"q": 12}), (100, {"hot": 2, "sampled": 1}), (50, {"hot": 1, "sampled": 1, "bits": 4}), (100, {"bits": 4}), (100, {"chunk": 130, "most": 500}), (30, {"q": 12, "chunk": 1}), (6, {"q": 4})])
def test_suffix_dedup_equals_brute_force(spark, n, kw):
    rows = passages(n)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, marks string, lo int").repartition(5)
    assert sorted(tuple(r) for r in suffix_dedup.dedup_digests(df, n, **kw).collect()) == brute_removed(rows, n)


@pytest.mark.parametrize("most", [40, 1 << 20])
def test_slices_find_their_own_repeats_by_refinement(most):
    rng, n = np.random.default_rng(5), 24
    base = bytes(rng.integers(97, 101, 400, dtype=np.uint8))
    docs = [base[:150], b"", base[100:300] + base[:90], b"a" * 120, base[50:200], base[50:200], b"x", b"a" * 60]
    order = np.array([3, 3, 1, 0, 4, 4, 5, 2])  # the fifth and sixth are one row twice
    raw, ends = b"".join(docs), np.cumsum([len(d) for d in docs])
    starts = np.append(0, ends[:-1])
    inside = np.zeros(len(raw), bool)
    for a, e in zip(starts, ends, strict=True):
        inside[a : max(a, e - n + 1)] = True
    h, lo, hi = suffix_dedup.runs_of(np.frombuffer(raw, np.uint8), inside, n, 6)
    known = suffix_dedup.known_runs(raw, starts, order, h, lo, hi, n, most)
    first = {}
    for d, k in sorted(((d, k) for d in range(len(docs)) for k in range(len(docs[d]) - n + 1)), key=lambda x: (order[x[0]], x[1])):
        first.setdefault(docs[d][k : k + n], (order[d], k))

    def repeats(i):
        d = int(np.searchsorted(ends, i, side="right"))
        return first[raw[i : i + n]] != (order[d], i - starts[d])

    expected = np.array([all(repeats(i) for i in range(a, b + 1)) for a, b in zip(lo, hi, strict=True)])
    assert expected.any() and not expected.all()
    assert (known == expected).all() if most > len(raw) else not (known & ~expected).any()  # a cut leaves more to travel, never less


def test_suffix_dedup_edges(spark):
    schema = "doc_id long, text string"
    assert suffix_dedup.dedup_digests(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "b" * 150), (1, "b" * 150), (None, "c" * 100), (7, "c" * 100)]
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_digests(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 150, 149), (None, 100, 0), (7, 100, 100)}
    same_id = [(1, "d" * 120 + "x"), (1, "d" * 120 + "y")]
    removed = sorted(r.n_removed for r in suffix_dedup.dedup_digests(spark.createDataFrame(same_id, schema)).collect())
    assert removed == [119, 120]


@pytest.mark.parametrize("strip", [1 << 15, 7])
def test_refinement_finds_all_repeats(strip):
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 99, 400).astype(np.uint8)
    ends = np.array([100, 100, 230, 400])
    for n in (4, 8, 10, 17, 40):
        raw, where = buf.tobytes(), {}
        at, bucket = suffix_dedup.refine(raw, ends, n, strip)
        for s, e in zip([0, *ends[:-1]], ends, strict=True):
            for p in range(s, e - n + 1):
                where.setdefault(raw[p : p + n], []).append(p)
        want = sorted(sorted(v) for v in where.values() if len(v) > 1)
        got = {}
        for p, b in zip(at.tolist(), bucket.tolist(), strict=True):
            got.setdefault(b, []).append(p)
        assert sorted(sorted(v) for v in got.values()) == want


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_library(tokenizer):
    path, pattern, lib = tokenizer
    c = bpe.Codec(path, pattern, memo=100_000)  # small, so that it is emptied now and then
    rng = random.Random(4)
    tokens = list(c.bytes.values())
    texts = ["", " ", "a" * 5000, "é" * 999, "\x85\x1c  x", "<|endoftext|> x", "I'll  we've\n\n 12345"]
    for alphabet in ("ab", "the aeinrst ", "0123456789", "=-*#", "áéíñü aeo", "你好世界的一是", "абвгдеж"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))).decode("utf-8", "ignore") for _ in range(3000)]
    for t in texts:
        ids = c.encode(t)
        assert ids == lib.encode_ordinary(t)
        assert c.decode(ids) == t.encode()


def test_token_digests(spark, tokenizer):
    path, pattern, lib = tokenizer
    rows = [(1, "Über the  moon!"), (1, "Über the  moon!"), (2, None), (None, ""), (3, "lang " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    got = bpe.token_digests(df, path, pattern).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "Über the  moon!", 3: "lang " * 3000}.get(r.doc_id, "")
        ids = lib.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    long = "Ein langer Text,  mit 12 Zahlen. " * 40_000
    ids = lib.encode_ordinary(long)
    assert bpe.codec(path, pattern).digest(long) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(long.encode()).hexdigest())
    full = {(r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_documents(df, path, pattern).collect()}
    assert (1, tuple(lib.encode_ordinary("Über the  moon!")), "Über the  moon!") in full
    assert bpe.token_digests(df.limit(0), path, pattern).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{x}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><p>Our site with a long line of words that is a motto</p></header><nav><ul><li><a href="/a">One</a></li><li><a href=/b>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies and many words to tell you so, again and again.</div><!-- <p>hidden</p> --><aside><p>Sidebar text, also rather long, with many words in it.</p></aside>
<article><h1>Head &lt;1&gt;</h1><p>First &eacute;t&#233;  <b>bold
 text</b> here.<br>After the break.<p>Second &nbsp; one.</article>
<section id="comments"><p>A reader has written a long comment about this with many words.</p></section><form><p>Your mail please</p><input></form><footer>&copy; 2024 us</footer></body></html>"""


def test_main_text_of_a_page(spark):
    assert html_extract.main_text(PAGE) == "Head <1> First été bold text here. After the break. Second one."
    assert [html_extract.main_text(x) for x in (None, "", "<p>", "<script>x", "<!--")] == [""] * 5
    plain = "<body><p>" + "word " * 40 + "</p><p>" + "more " * 40 + "</p></body>"
    assert html_extract.main_text(plain) == ("word " * 40 + "more " * 40).strip()
    df = spark.createDataFrame([(1, "u", PAGE, 0), (1, "u", PAGE, 0), (None, None, None, 0)], "page_id long, url string, html string, text int")
    got = html_extract.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 63, 63] and html_extract.extract(df.limit(0)).count() == 0


def words(n, c="w"):
    return " ".join([c] * n)


ART = f"<p>{words(50)}</p><p>{words(40)}</p>"


@pytest.mark.parametrize("before", ["<nav><a>b b b b b b</a></nav>", f'<div class="cookie-notice">{words(12, "b")}</div>', f"<aside>{words(9, 'b')}</aside>", f"<form>{words(7, 'b')}</form>", f'<div class="ad">{words(9, "b")}</div>', f"<header><p>{words(16, 'b')}</p></header>"])
def test_marked_boilerplate_before_an_article_goes(before):
    assert html_extract.main_text(before + ART) == words(90)


@pytest.mark.parametrize("name", ["post type-post tag-economy category-x", "story share-price-analysis", "post sidebar-left", "page-content-side", "articleBody", "entry-content"])
def test_articles_with_odd_class_names_stay(name):
    assert html_extract.main_text(f'<nav><a>b</a></nav><div class="{name}">{ART}</div><footer>b b</footer>') == words(90)


def test_comments_apostrophes_and_long_pages():
    assert html_extract.main_text(f'<main>{ART}<section id="discussion"><p>{words(30, "b")}</p></section></main>') == words(90)
    assert html_extract.main_text(f"<main><p title=it's class='x'>{words(30)}</p><p>a &lt;b&gt; c</p></main><p") == words(30) + " a <b> c"
    long = html_extract.main_text("<nav><a>b</a></nav><article>" + "<p>w w w <b>w</b> w w</p>" * 40_000 + "</article>")
    assert long == words(240_000)


#: Pages that teach the tree nothing: g is the article's, b is not.
HELD_OUT = (
    f"<div id=top-nav><a>b b</a><a>b</a></div><div class=story-body><h1>{words(7, 'g')}</h1><p>{words(33, 'g')}</p><p>{words(71, 'g')}</p><p>{words(9, 'g')}</p></div><div class=sidebar><h4>b b</h4><a>{words(6, 'b')}</a></div>",
    f"<header class=masthead><a>b</a></header><main role=main><h1>{words(5, 'g')}</h1><ol><li>{words(14, 'g')}<li>{words(3, 'g')}<li>{words(22, 'g')}</ol><p>{words(51, 'g')}</p></main><div role=contentinfo>{words(20, 'b')}</div>",
    f"<ul><li><a>b</a><li><a>b b</a><li><a>b</a><li><a>b b</a></ul><h1>{words(6, 'g')}</h1><p>{words(38, 'g')}</p><p>{words(27, 'g')}</p><p>{words(90, 'g')}</p><p><a>{words(5, 'b')}</a></p><p><a>{words(8, 'b')}</a></p>",
    f"<div class='banner top'>{words(24, 'b')}</div><article id=a1 class='hentry'><p>{words(44, 'g')}</p><aside>{words(30, 'b')}</aside><p>{words(60, 'g')}</p><ul class='share-buttons'><li><a>b</a><li><a>b</a></ul></article><div class=comments-area><p>{words(80, 'b')}</p></div>",
    f"<div class=wrap><p>{words(64, 'g')}</p><p>{words(29, 'g')}</p></div><div class=subscribe-box><p>{words(17, 'b')}</p><form>{words(6, 'b')}</form></div>",
    f"<form id=aspnet><nav><a>b b</a></nav><main><p>{words(41, 'g')}</p><p>{words(58, 'g')}</p></main></form>",
    f"<nav><a>{words(3, 'b')}</a></nav><div class=consent-popup><p>{words(45, 'b')}</p></div>",
)


def test_held_out_pages():
    kept = gold = right = 0
    for page in HELD_OUT:
        got = html_extract.main_text(page).split()
        kept, gold, right = kept + len(got), gold + len(re.findall(r"\bg\b", page)), right + got.count("g")
    assert right / kept > 0.97 and right / gold > 0.97


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>b</title><meta charset=x><body><p>{words(60)}</p>{ART}", f"<html><head><style>b</style>{ART}", f"<div><button></div>{ART}<button>b</button>", f"<video src=x>{ART}", f"<div><svg><svg>b</svg>b</svg></div>{ART}",
        f"<form><p>{words(60)}</p><p>{words(60)}</p></form>", f"<form><div class=content><p>{words(60)}</p>{ART}</div></form>", "<p>w w</p><p>w w w</p>", "<p>w w w</p>", "w", "<h1>w w</h1><p>w w w w</p>", f"<noscript>b <p>b</p></noscript>{ART}",
        f"{ART}<p>All rights reserved by b</p>", f"<main>{ART}<div class=user-feedback><p>{words(30, 'b')}</p></div></main>", f"<p>{words(40)}</p><select><option>b<option>b</select><p>{words(30)}</p>", f"<article>{ART}<p>w<math><mi>w</mi></math></p></article>", f"<template><p>b</p></template>{ART}",
    ],
)
def test_no_article_is_lost_or_mixed(page):
    """Missing end tags, forms around the page, short pages, closing lines: w is the article's, all of it and nothing else."""
    got = html_extract.main_text(page)
    assert got and set(got) <= {"w", " "}
    assert got.count("w") == len(re.findall(r"\bw\b", re.sub("<[^>]*>", " ", page)))


def test_an_article_may_quote_a_closing_line():
    assert html_extract.main_text(f"<article><h1>All rights reserved.</h1>{ART}</article>").startswith("All rights reserved. w")


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(again), len(lines)


def test_base_counts_equal_brute_force():
    rng = random.Random(1)
    cases = [None, "", " \n ", "one", "a b c d e a b c d e", "x\n\nx\n x\nx ", "é#ü $$ |x\x1cy"]
    cases += ["".join(rng.choice(["a ", "b ", "c\n", "é ", "# ", "d"]) for _ in range(rng.randint(1, 120))) for _ in range(200)]
    for t in cases:
        assert quality_rules.base_counts(t) == brute_counts(t)
    assert quality_rules.base_counts("w " * 100_000) == (100_000, 100_000, 0, 0, 100_000, 1)


def test_upper_bound_is_exact():
    for k, n, delta in ((0, 100, 0.05), (3, 250, 0.01), (7, 40, 0.1)):
        p = quality_rules.upper_bound(k, n, delta)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(tail - delta) < 1e-9
    assert quality_rules.upper_bound(0, 0, 0.05) == 1.0 and quality_rules.upper_bound(5, 5, 0.05) == 1.0


def labelled_corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7)))
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = [word() + ("###&&" if bad else "") for _ in range(40)]
        docs.append((i, " ".join(words), "en" if i % 10 else None, "s", 1))
        if i % 2:
            labels.append((i, int(not bad), 0))
    return docs, labels


def test_cutoffs_reject_bad_and_spare_good(spark):
    docs, labels = labelled_corpus(3, 6000)
    docs += [(9001, None, "en", "s", 1), (9002, "short", None, None, None), (9003, " ".join("#####" + chr(97 + i) for i in range(20)), "xx", "s", 1), (None, docs[0][1], "en", "s", 1)]
    d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(d, lab).collect()}
    good = {i: y for i, y, _ in labels}
    spared = [got[i].kept for i in good if good[i] and docs[i][2]]
    caught = [not got[i].kept for i in good if not good[i] and docs[i][2]]
    assert sum(spared) / len(spared) >= 0.99 and sum(caught) / len(caught) > 0.9
    assert got[9001].base_failed and got[9002].base_failed and got[9003].n_symbols == 100
    assert got[9003].kept  # nothing is known of that stratum
    assert all(got[i].kept for i in range(0, 6000, 10) if not got[i].base_failed)  # nor of the stratum without language: odd ids have labels
    cuts = {r.stratum: r for r in quality_rules.learn_cutoffs(quality_rules.add_base(d), lab).collect()}
    assert set(cuts) == {"=en"} and all(0 < r.bound <= 0.03 and r.bad_rejected > 0.9 * r.n_bad for r in cuts.values())
    few = quality_rules.learn_cutoffs(quality_rules.add_base(d), lab.where("doc_id < 100")).collect()
    assert all(math.isinf(r.symbols_per_word) for r in few)
    kept = {r.doc_id for r in quality_rules.kept_documents(d, lab).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    empty = quality_rules.quality_verdicts(d, lab.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in empty) and quality_rules.quality_verdicts(d.limit(0), lab).count() == 0


def test_cutoffs_equal_plain_tests_of_every_stratum(spark):
    """Trials counted one by one; a step holds if a stratum at the risk would show as few errors only with its share of delta."""
    docs, labels = labelled_corpus(5, 3000)
    for i in range(3000):
        docs[i] = (*docs[i][:2], ("en", "fr", "tiny")[0 if i % 3 else 2 if i % 60 == 3 else 1], *docs[i][3:])
    docs += docs[:900] * 2  # rows again are no further trials
    d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    base = quality_rules.add_base(d)
    _, path, best = quality_rules.holdout_counts(base, lab)
    values = quality_rules.rule_values()
    rows = base.where(~quality_rules.base_failed()).select("doc_id", "stratum", (F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4)) == 0).alias("tune"), *[values[r].alias(r) for r in quality_rules.RULES]).collect()
    y = {i: q for i, q, _ in labels}
    good = {}
    for r in rows:
        if not r.tune and y.get(r.doc_id) == 1:
            good.setdefault(r.stratum, {})[r.doc_id] = [r[x] for x in quality_rules.RULES]

    def tail(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    m = max(k for k in (1, 2, 3) if k == 1 or sum(tail(0, len(x), 0.03) <= 0.05 / k for x in good.values()) >= k)
    able = [s for s, x in good.items() if tail(0, len(x), 0.03) <= 0.05 / m]
    got = {r.stratum: r for r in quality_rules.learn_cutoffs(base, lab).collect()}
    assert set(got) == {"=en", "=fr", "=tiny"} and "=en" in able and "=tiny" not in able and best >= 0
    for s, x in good.items():
        level = -1
        for t in range(best + 1) if s in able else ():
            errors = sum(any(v > c for v, c in zip(row, path[t], strict=True)) for row in x.values())
            if tail(errors, len(x), 0.03) > 0.05 / len(able):
                break
            level = t
        assert [got[s][r] for r in quality_rules.RULES] == (path[level] if level >= 0 else [math.inf] * 5) and got[s].n_good == len(x)


def test_no_stratum_answers_for_another(spark):
    docs, labels = labelled_corpus(3, 6000)
    odd = [(7000 + i, " ".join("#####" + chr(97 + (i + j) % 26) * 3 for j in range(20)), f"x{i % 3}", "s", 1) for i in range(60)]  # good, with many signs
    d, lab = spark.createDataFrame(docs + odd, DOC), spark.createDataFrame(labels + [(7000 + i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_verdicts(d, lab).where("doc_id >= 7000").collect()
    assert len(got) == 60 and all(r.kept for r in got)
    again = spark.createDataFrame([x for x in odd if x[2] == "x0"] * 40, DOC)  # 20 documents, 800 rows
    cuts = quality_rules.learn_cutoffs(quality_rules.add_base(again), lab).collect()
    assert [r.n_good <= 20 and math.isinf(r.symbols_per_word) for r in cuts] == [True]
    clash = d.withColumns({"n_words": F.lit(1), "stratum": F.lit("z"), "kept": F.lit(False), "y": F.lit(0)})  # columns of these names change nothing
    assert sorted(quality_rules.quality_verdicts(clash, lab).where("doc_id >= 7000").collect()) == sorted(got)


MIX_ROWS = [(i, "w " * (i % 23), "en", f"s{i % 5}" if i % 7 else None, 1) for i in range(400)] + [(500, None, "en", "s1", 1), (501, "big " * 5000, "en", "s2", 1), (502, "x", "en", "S", 1), (None, "y z", "en", "s0", 1)]


def test_mix_equals_its_sql(spark):
    d = spark.createDataFrame(MIX_ROWS, DOC)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.size, r.source_size, r.target, r.taken, r.position) for r in mixing.mixing_plan(d).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", MIX_ROWS)
    q = con.execute("SELECT coalesce(doc_id, -1), size, source_size, target, taken, position FROM (" + mixing.MIX_SQL + ")")
    assert got == sorted(q.fetchall(), key=repr)


def test_mix_meets_its_targets(spark):
    d = spark.createDataFrame(MIX_ROWS, DOC)
    rows = mixing.mix(d).collect()
    sums = {}
    for r in rows:
        s = sums.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r.size
        assert 0 <= r.taken <= 2 * r.size
    total = sum(s[1] for s in sums.values())
    names = sorted(k for k in sums if k) + [None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    left, target, open_ = 1.5 * total, {}, set(names)
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if level * weight[n] > 2 * sums[n][3]}
        for n in full or open_:
            target[n] = 2 * sums[n][3] if full else level * weight[n]
        left -= sum(target[n] for n in full)
        open_ = open_ - full if full else set()
    for n, (taken, size, t, source_size) in sums.items():
        assert size == source_size and abs(t - target[n]) < 1e-6 * max(1, t) and abs(taken - t) <= 1
    assert mixing.mixing_plan(d.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0)], DOC)
    assert sorted((r.doc_id, r.size, r.taken, r.position) for r in mixing.mixing_plan(empty).collect()) == [(1, 0, 0, None), (2, 0, 0, None)]


def test_mixed_documents_have_the_words_taken(spark):
    d = spark.createDataFrame([(*r, 0) for r in MIX_ROWS if r[0] is not None], DOC + ", size int")
    taken = {r.doc_id: r.taken for r in mixing.mix(d).collect()}
    out = mixing.mixed_documents(d).collect()
    words = {}
    for r in out:
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    assert {i: n for i, n in words.items() if n} == {i: n for i, n in taken.items() if n}
    again = mixing.mixed_documents(d.repartition(7)).collect()
    assert [tuple(r) for r in out] == [tuple(r) for r in again]
