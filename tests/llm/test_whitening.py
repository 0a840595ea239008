"""Whitening against a full eigendecomposition, and the solver on matrices larger than its basis."""

import math

import numpy as np
import pytest
from brookline.llm import whitening as wh


def plain(rows, k=4):
    """By NumPy's own decomposition: rows of (vec_id, component) to (n, deviation, |whitened|, explained)."""
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, x.values()))), np.int64)
    n, s = len(fit), fit.sum(0)
    e, u = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, v in x.items():
        a = n * np.array(v, object) - s.astype(object)
        for c in range(min(k, len(s))):
            out[i, c + 1] = (n, int((a * a).sum()), abs(float((np.array(v) - s / n) @ u[:, c]) / math.sqrt(e[c])), e[c] / e.sum())
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    signs = {}
    for r in got:
        n, deviation, size, explained = want[r.vec_id, r.component]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(size, abs=1e-8) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9 and r.residual <= wh.RESIDUAL
        signs.setdefault(r.component, []).append(r.whitened)
    return signs


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(wh.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect(), plain(rows))


def test_signs_agree_among_rows_and_repeats_count_once(spark):
    rng = np.random.default_rng(3)
    base = [(i, (rng.standard_normal(6) * [5, 3, 2, 1.5, 1, 0.5]).round(3).tolist()) for i in range(60)]
    rows = base + [(1000 + i, base[0][1]) for i in range(500)]  # a hot vector
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    check(got, plain(rows))
    by = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(by[1000, c] == by[0, c] for c in range(1, 5)) and got[0].n == 60
    for c in range(1, 5):  # one sign for all rows: whitened values of distinct vectors sum to nothing and have unit variance
        own = np.array([by[i, c] for i in range(60)])
        assert abs(own.mean()) < 1e-9 and own.var() == pytest.approx(1)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.5, 0.5]), (None, [2.0, 2.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (8, []), (9, [1.0]), (3, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, x int, component string")
    got = wh.whiten(df).collect()
    assert sorted((r.vec_id or -1) for r in got) == [-1, -1, 1, 1, 2, 2, 3, 3, 3, 3] and {r.n for r in got} == {4}
    assert wh.whiten(df.limit(0)).collect() == []
    assert wh.whiten(df.where("vec_id = 1")).collect() == []  # no variance, no component
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in wh.whiten(line).collect()} == {1}


@pytest.mark.parametrize("d", [5, 40, 300])
def test_solver_beyond_its_basis(d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = np.sort(rng.uniform(1, 2, d))[::-1] * np.linspace(3, 1, d)
    a = q * e @ q.T
    values, vectors, residual, calls = wh.lobpcg(lambda w: a @ w, d, 4, block=16)
    order = np.sort(e)[::-1][:4]
    assert values == pytest.approx(order, rel=1e-12) and residual <= wh.RESIDUAL and calls < 120
    assert np.abs(a @ vectors - vectors * values).max() < 1e-11 and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_equal_eigenvalues_and_low_rank():
    values, vectors, _, _ = wh.lobpcg(lambda w: 3.0 * w, 90, 4, block=8)
    assert values == pytest.approx([3.0] * 4)
    u = np.linalg.qr(np.random.default_rng(1).standard_normal((90, 2)))[0]
    values, vectors, _, _ = wh.lobpcg(lambda w: u @ (np.array([[5.0], [2.0]]) * (u.T @ w)), 90, 4, block=8)
    assert values == pytest.approx([5.0, 2.0, 0.0, 0.0], abs=1e-12)
    assert wh.lobpcg(lambda w: 0.0 * w, 9, 4)[0] == pytest.approx([0.0] * 4)


def test_squares_are_exact():
    rng = np.random.default_rng(2)
    for hi, n in ((200, 50), (10**6, 10**9)):
        x = rng.integers(-hi, hi, (20, 7))
        s = [int(v) for v in rng.integers(-hi * n, hi * n, 7)]
        assert wh.squares(x, n, np.array(s, object)) == [sum((n * int(c) - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    with pytest.raises(OverflowError):
        wh.squares(np.array([[1 << 40]]), 1 << 30, np.array([0], object))
