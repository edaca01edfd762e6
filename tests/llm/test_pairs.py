"""Near-duplicate operators against brute force over all pairs."""

import math

import numpy as np
import pytest
import xxhash

from stockloom.llm import embedding_dedup, simhash
from stockloom.llm.common import deal_tiles, whole_groups
from stockloom.llm.components import connected_components


def smallest_reachable(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 299), (299, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = smallest_reachable({x for pair in links for x in pair}, links)
    assert got == {n: c for n, c in want.items() if n != 200}
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [1000, 3])
def test_tiles_let_every_pair_meet_once(spark, tile):
    rows = [(k, m) for k, n in ((1, 10), (2, 1), (3, 4)) for m in range(n)]
    cells = deal_tiles(spark.createDataFrame(rows, "k long, m long"), "k", "m", tile).collect()
    met = []
    for key in {(r.k, r.cell_a, r.cell_b) for r in cells}:
        own = [r for r in cells if (r.k, r.cell_a, r.cell_b) == key]
        met += [(key[0], x.m, y.m) for x in own for y in own if x.m < y.m and (key[1] == key[2] or x.part != y.part)]
    assert sorted(met) == sorted((k, a, b) for k, a in rows for k2, b in rows if k == k2 and a < b)


def test_whole_groups_never_splits_a_group():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2])], names=["k"]) for i in range(0, len(keys), 2)]
    got = [t.column("k").to_pylist() for t in whole_groups(iter(batches), ["k"]) if t is not None]
    assert [x for g in got for x in g] == keys
    for a, b in zip(got, got[1:], strict=False):
        assert a[-1] != b[0]


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(12):
            base = rng.standard_normal(16)
            for _ in range(rng.integers(1, 5)):
                rows.append((i, [float(x) for x in base + rng.standard_normal(16) * 0.07], label))
                i += 1
    rows += [(i + k, rows[3][1], rows[3][2]) for k in range(3)]  # copies
    i += 3
    rows += [(i, rows[3][1], 1 - rows[3][2]), (i + 1, None, 0), (i + 2, [0.0] * 16, 0), (i + 3, [math.nan] + [1.0] * 15, 0), (i + 4, [None] + [1.0] * 15, 0), (i + 5, rows[3][1], None), (i + 6, [math.inf] + [1.0] * 15, 0), (i + 7, [1.0], 0)]
    return rows


@pytest.mark.parametrize("tile", [512, 4])
def test_embedding_links_equal_brute_force(spark, tile):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, tables=40, tile=tile).collect()}
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] is not None and a[2] == b[2] and fine(a[1]) and fine(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links.append((a[0], b[0]))
    want = smallest_reachable([r[0] for r in rows], links)
    assert len(got) == len(rows) and len(links) > 20
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (sum(i in pair for pair in links), want[i], want[i] == i)


def test_nothing_is_broadcast_on_the_way_to_links_and_components(spark):
    """The planner sizes a list of keys by one key: at some 60 000 vectors it broadcast 4.9 million rows and the driver ran out of memory."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + 0.01 * rng.standard_normal(16)).tolist(), "a") for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    embedding_dedup.near_duplicates(df)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = store.executionsList(int(before), 1000)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)


def test_recall_of_pairs_at_the_threshold_with_production_parameters(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((1500, 64))
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.9301, 0.945, 1500)[:, None]
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * side])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cos = unit @ unit.T
    np.fill_diagonal(cos, 0)
    want = (cos >= 0.93).sum(axis=1)
    assert sum(r.n_links for r in got.values()) >= 0.97 * want.sum() > 2900 and all(got[i].n_links <= want[i] for i in got)


def test_buckets_do_not_grow_with_the_rows():
    near, far = embedding_dedup.agreement(math.sqrt(0.14), 2.0), embedding_dedup.agreement(math.sqrt(2), 2.0)
    before = 0
    for n in (100, 10_000, 1_000_000, 10**7, 10**8, 10**9):
        tables, k = embedding_dedup.shape(n, 0.93, 2.0)
        assert 1 - (1 - near**k) ** tables >= 0.98 and n * far**k <= 1 and before <= tables <= 1600
        before = tables


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a"), (None, [1.0, 2.0], "a")], schema)
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(twice).collect())
    assert [g for g in got if g[0] > 0] == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def texts():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdeé"), 3))
    out = [" ".join(word() for _ in range(rng.integers(1, 40))) for _ in range(150)]
    for i in range(60):  # near copies: a word changed in a long text
        base = " ".join(word() for _ in range(300)).split() if i % 6 == 0 else out[-1].split()
        base[int(rng.integers(0, len(base)))] = word()
        out.append(" ".join(base))
    return [*out, out[0], out[0].upper().replace("É", "é"), None, "", " \t\n", "one", "one two", "ONE two ", "a b", "x " * 5000]


def test_fingerprints_equal_brute_force():
    for t in texts():
        assert simhash.fingerprint(t) & (2**64 - 1) == brute_fingerprint(t)


@pytest.mark.parametrize(("radius", "tile"), [(2, 2048), (2, 8), (9, 8)])
def test_simhash_components_equal_brute_force(spark, radius, tile):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "c", 7) for i, t in rows], "doc_id long, text string, fp string, rep int")
    got = {r.doc_id: r for r in simhash.simhash_near_dups(df, radius=radius, tile=tile).collect()}
    fp = {i: brute_fingerprint(t) for i, t in rows}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= radius]
    want = smallest_reachable(list(fp), links)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_simhash_edges(spark):
    schema = "doc_id long, text string"
    assert simhash.simhash_near_dups(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, None)], schema)
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.simhash_near_dups(rows).collect())
    assert got == [(-1, 4), (4, 4), (4, 4), (9, 9)]
    nameless = simhash.simhash_near_dups(rows.where("doc_id IS NULL")).first()
    assert nameless.component_id is None and nameless.kept
    long = " ".join(str(i % 991 * i) for i in range(140_000))  # several blocks of 65 536 shingles
    assert simhash.fingerprint(long) & (2**64 - 1) == brute_fingerprint(long)


def test_tiles_beyond_the_radius_are_skipped(spark):
    block = 0x123456  # one bit block in common, bit counts from few to many
    fps = [(block << 40) | ((1 << k) - 1) for k in range(0, 40, 1)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    row = simhash.tile_pairs(df).first()
    assert row.skipped > row.compared > 0
    cells = {r.cell for r in simhash.banded(df, 2).where("block = 2").collect()}
    assert len(cells) > 10  # one block value, many cells: bands far apart never meet
    comp = {r.component for r in simhash.simhash_components(df).collect()}
    assert len(comp) == 1  # neighbours differ by one bit


def test_one_of_each_keeps_one_row_of_each_component(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (7, "a b c d"), (None, "a b c d"), (3, "other words here now"), (5, "other words here now"), (None, "only without id"), (None, "only without id"), (9, None), (8, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(df).collect()), key=repr)
    assert got == sorted([(3, "a b c d"), (3, "other words here now"), (None, "only without id"), (8, "")], key=repr)
    assert simhash.one_of_each(df.limit(0)).count() == 0
