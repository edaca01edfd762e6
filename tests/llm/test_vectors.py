"""Vector codes and whitening against brute force."""

import hashlib

import numpy as np
import pytest

from stockloom.llm import spectrum, vector_codes, whitening


def rows_of(n=700, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[5]  # one vector holds a third of all rows
    x[-20:] = x[:20]
    return [(int(i), [float(v) for v in r], int(i) % 3 if i % 7 else None) for i, r in zip(rng.permutation(n), x, strict=True)]


BAD = [(9001, None, 1), (9002, [1.0, None] + [0.0] * 6, 1), (9003, [float("nan")] + [0.0] * 7, 1), (9004, [float("inf")] + [0.0] * 7, None)]
SCHEMA = "vec_id long, embedding array<double>, label int"


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    rows = sorted(rows)
    x = np.floor(np.array([r[1] for r in rows]) * scale).astype(np.int64).reshape(len(rows), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]

    def assign(p):
        d = ((x[:, p][:, None, :] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = assign(p)
            for k in range(len(books[p])):
                if (at == k).any():
                    books[p][k] = x[at == k, p].sum(axis=0) // (at == k).sum()
    found = [assign(p) for p in range(parts)]
    errors = sum(f[1] for f in found)
    total = {}
    for r, e in zip(rows, errors, strict=True):
        total[r[2]] = total.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return {r[0]: ("".join(f"{f[0][i]:02x}" for f in found), int(errors[i]), total[r[2]], digest) for i, r in enumerate(rows)}


@pytest.mark.parametrize("entries", [256, 16])
def test_codes_equal_plain_lloyd(spark, entries):
    rows = rows_of()
    df = spark.createDataFrame(rows + BAD, SCHEMA).selectExpr("*", "'x' AS code", "1 AS error").repartition(5)
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(df, entries=entries).collect()}
    assert got == plain_codes(rows, entries=entries)


def test_large_components_take_the_exact_path():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 27), 1 << 27, (50, 4))
    book = x[:7] + rng.integers(-1, 2, (7, 4))
    book[3] = book[2]
    entry, far = vector_codes.nearest(x, book)
    d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in book] for r in x], object)
    assert entry.tolist() == d.argmin(axis=1).tolist() and far.tolist() == d.min(axis=1).tolist()


def test_members_that_keep_their_entry_stay_where_they_are():
    import pyarrow as pa

    books = np.array([[[0, 0], [100, 100]]])
    owners = vector_codes.Owners(books, np.array([[5000, 3]]), 2)
    assert owners.salts.tolist() == [[10, 1]]
    ints = lambda *v: pa.array(v, pa.int32())
    batch = pa.RecordBatch.from_arrays([ints(0, 0, 0), ints(0, 0, 1), ints(7, 3, 0), ints(17, 23, 25), pa.array([[1, 1], [99, 99], [3, 3]], pa.list_(pa.int32()))], names=["position", "entry", "salt", "seed", "part"])
    got = next(vector_codes._reassigned(owners)(iter([batch]))).to_pydict()
    assert got["entry"] == [0, 1, 0] and got["moved"] == [False, True, True] and got["salt"] == [7, 0, 5]


@pytest.mark.parametrize("kind", ["empty", "bad", "one", "ragged", "ids"])
def test_edges_of_codes(spark, kind):
    rows = {"empty": [], "bad": BAD, "one": [(1, [0.5] * 8, None)], "ragged": [(1, [1.0] * 5, 1), (2, [], 1), (3, [3e38] * 5, 2)], "ids": [(None, [1.0] * 8, 1), (2, [0.0] * 8, 1), (2, [0.0] * 8, 1), (2, [-1.0] * 8, 1)]}[kind]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()
    if kind in ("empty", "bad"):
        assert got == []
    elif kind == "one":
        assert [(r.code, r.error, r.label_error) for r in got] == [("00000000", 0, 0)]
    elif kind == "ragged":
        assert {r.vec_id: r.code for r in got} == {1: "00000000", 2: "01010100", 3: "02020200"}
    else:
        assert sorted((r.vec_id or 0, r.code) for r in got) == [(0, "01" * 4), (2, "00" * 4), (2, "00" * 4), (2, "00" * 4)]


def test_many_labels_join_by_shuffle(spark, monkeypatch):
    rows = rows_of(300)
    monkeypatch.setattr(vector_codes, "SMALL_SIDE", 0)
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain_codes(rows)


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    v = q @ np.diag(values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [range(-10, 11), [0] * 5 + [1] * 4, [3, -3] * 6, [1e-9, 1e9, -1e9, 5, 0.0]])
def test_inertia(values):
    v = symmetric(list(values), 2)
    for shift in (0.5, -0.5, 2.5, -7.5):
        assert spectrum.positives(v - shift * np.eye(len(v))) == sum(x > shift for x in values)
    assert spectrum.positives(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert spectrum.positives(np.zeros((3, 3))) == 0


@pytest.mark.parametrize(
    "values",
    [list(np.linspace(1, 2, 40)), [5, 5, 5, 4, 4, 1] + [0] * 10, [1] * 20, [7], [2, 2 - 1e-14, 2 - 1e-9, 1, 1e-3], [1e6, 1, 1e-6, 1e-9, 0], [0, 0], list(1 + np.arange(30) * 1e-6)],
)
def test_leading_pairs(values):
    v = symmetric(values, 4)
    got, vectors = spectrum.leading(v, 16)
    want = [x for x in sorted(values, reverse=True)[:16] if x > 16 * len(v) * 2.3e-16 * np.abs(v).sum(axis=1).max()]
    assert len(got) == len(want)
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-13 * max(values))
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-6)
    assert np.abs(v @ vectors - vectors * got).max(initial=0) <= 1e-12 * max(values)


def test_whitening_equals_brute_force(spark):
    rows = [(i, v + [0.3 * v[0] + 100.0] * 12, n) for i, v, n in rows_of(400, 8)]
    bad = [(i, v + [0.0] * 12 if v else v, n) for i, v, n in BAD]
    df = spark.createDataFrame(rows + bad + rows[:3], SCHEMA).selectExpr("*", "1 AS n", "2 AS component").repartition(4)
    got = whitening.whiten(df).orderBy("vec_id", "component").toPandas()
    x = {i: np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000 for i, v, _ in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = got.component.max()
    assert k == 9 and len(got) == (len(rows) + 3) * k  # twelve components are one
    assert got.n.unique().tolist() == [n] and got.identity_error.max() < 1e-6
    one = got.drop_duplicates(["vec_id", "component"])
    w = one.whitened.values.reshape(-1, k)
    ids = one.vec_id.values[::k]
    want = np.stack([(x[i] - s / n) @ vectors[:, :k] / np.sqrt(values[:k]) for i in ids])
    np.testing.assert_allclose(w, want * np.sign((w * want).sum(axis=0)), atol=1e-6)
    np.testing.assert_allclose(one.explained.values[:k], values[:k] / np.trace(v), rtol=1e-9)
    assert one.deviation.values[::k].tolist() == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s, strict=True)) for i in ids]


def test_exact_sums_of_large_components():
    rng = np.random.default_rng(2)
    for top in (1 << 10, 1 << 31):
        z = rng.integers(-top, top, (60, 5))
        assert (whitening.products(z, rows=16) == z.astype(object).T @ z.astype(object)).all()


@pytest.mark.parametrize("rows", [[], BAD, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)]])
def test_no_spread_no_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_short_and_huge_vectors(spark):
    rows = [(1, [3e38, -3e38], 1), (2, [1.0], 1), (None, [], 1), (4, [0.0, 5.0], 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and {r.component for r in got} == {1}  # rounding cannot tell the second from zero
    assert all(r.n == 4 and (r.deviation is None or r.deviation >= 0) for r in got) and {r.vec_id for r in got if r.deviation is None} == {1, 4}  # beyond a long; the others are right below
