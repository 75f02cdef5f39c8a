import numpy as np
import pytest

from turnwise.llm.whitening import solve, triangle, whiten


def brute(rows, k=4):
    """{id: [(deviation, whitened, explained)]} and n, by an eigendecomposition of the covariance."""
    good = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n, mean = len(fit), fit.mean(0)
    e, vec = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    e, vec = e[::-1], vec[:, ::-1]
    sums = [sum(int(x[j]) for x in fit) for j in range(fit.shape[1])]
    out = {}
    for i, x in good:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        out[i] = [(dev, float((np.array(x) - mean) @ vec[:, c] / np.sqrt(max(e[c], 1e-300))), float(e[c] / e.sum())) for c in range(min(k, len(mean)))]
    return n, out


def same(got, want, n):
    flips = {}
    assert len(got) == sum(len(v) for v in want.values())
    for r in got:
        dev, w, explained = want[r.vec_id][r.component - 1]
        flip = flips.setdefault(r.component, np.sign(w) * np.sign(r.whitened) if abs(w) > 1e-3 else None)
        if flip is None:
            del flips[r.component]
        assert r.n == n and r.deviation == (dev if dev < 1 << 63 else None) and r.explained == pytest.approx(explained, rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(w), abs=1e-8) if flip is None else r.whitened * flip == pytest.approx(w, abs=1e-8)
        assert r.identity_error < 1e-10


def test_whole_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    n, want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    same(whiten(vectors).collect(), want, n)


def test_badly_conditioned_rows_and_repeated_ones(spark):
    """Components from 1e-2 to 1e6 apart in size; vectors that many rows hold count once in the fit."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 5) * [1e6, 1e3, 10, 1, 0.05] + 7).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    n, want = brute(rows)
    assert n == 300
    same(whiten(vectors).collect(), want, n)


def test_dependent_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [a, b, a, 3.0, a + b]) for i, (a, b) in enumerate(rng.integers(-50, 50, (100, 2)).astype(float).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, want = brute(rows)
    for r in whiten(vectors).collect():
        if r.component <= 2:
            assert abs(r.whitened) == pytest.approx(abs(want[r.vec_id][r.component - 1][1]), abs=1e-9) and r.identity_error < 1e-10
        else:
            assert r.whitened is None and r.explained == pytest.approx(0, abs=1e-20)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [3.0, 1.0]), (None, [0.5, 0.25]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 1.0, 1.0]), (8, [-0.001, 5.0]), (9, [4.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n int")
    got = whiten(vectors).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in got) == [(-1, 1), (-1, 2), (1, 1), (1, 1), (1, 2), (1, 2), (7, 1), (7, 2), (7, 3), (8, 1), (8, 2), (9, 1)]
    assert {(r.n, r.deviation, r.whitened, r.explained) for r in got if r.vec_id in (7, 9)} == {(1, 0, None, None)}
    assert {r.n for r in got if r.vec_id not in (7, 9)} == {4}
    assert whiten(vectors.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten(huge).collect()} == {None}


def test_substitution_and_shift():
    rng = np.random.default_rng(0)
    a = rng.normal(0, 1, (50, 7))
    r = triangle(a.T @ a, 0.0)
    assert np.allclose(solve(a, r) @ r, a) and np.allclose(np.tril(r, -1), 0)
    flat = np.outer(np.arange(1.0, 5), np.arange(1.0, 5))
    assert np.allclose(triangle(flat, 0.0).T @ triangle(flat, 0.0), flat, atol=1e-9)
