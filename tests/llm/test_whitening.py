"""Operator 13: eigenvectors, exact deviations and whitening against a dense computation."""

import numpy as np
import pytest

from cohortica.llm.whitening import Mean, fit_whitening, jacobi_davidson, whiten


def dense(x):
    """Mean, eigenvalues and vectors of the distinct rows."""
    fit = np.unique(x, axis=0).astype(float)
    c = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / len(fit))
    return len(fit), fit.mean(axis=0), e[::-1], v[:, ::-1]


def test_solver_against_dense():
    rng = np.random.default_rng(1)
    for dims, spectrum in ((64, np.linspace(1, 2, 64)), (50, 0.5 ** np.arange(50)), (30, np.r_[[3.0, 3.0, 3.0, 3.0, 3.0], np.ones(25)]),
                           (3, np.array([2.0, 1, 0])), (1, np.ones(1)), (20, np.zeros(20)), (64, np.r_[1 + 1e-6 * np.arange(6), np.zeros(58)])):
        q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        a = q * spectrum @ q.T
        values, vectors, residuals = jacobi_davidson(lambda w: a @ w, dims, 4)
        k = min(4, dims)
        np.testing.assert_allclose(values, np.sort(spectrum)[::-1][:k], atol=1e-13)
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(k), atol=1e-13)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * max(1, spectrum.max())


def test_whitening_against_dense(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((700, 12)) * np.linspace(2, 0.3, 12)
    rows = [(i, base[i % 600].tolist(), "clash", 1) for i in range(900)]
    rows += [(None, base[0].tolist(), None, None), (1000, None, None, None), (1001, [float("nan")] * 12, None, None),
             (1002, [None] + [0.0] * 11, None, None), (1003, [float("inf")] * 12, None, None), (1004, [], None, None),
             (1005, [1.0, -0.0], None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n int").repartition(6)
    model = fit_whitening(df)
    good = [r for r in rows if r[0] is None or r[0] < 1000 or r[0] >= 1004]
    full = np.zeros((len(good), 12))
    for i, r in enumerate(good):
        full[i, :len(r[1])] = np.float32(r[1])
    x = np.floor(256 * full).astype(np.int64)
    n, mean, e, v = dense(x)
    out = whiten(df, model).collect()
    assert len(out) == 4 * len(good)
    sign = np.sign((model.vectors * v[:, :4]).sum(axis=0))
    y = (x - mean) @ (v[:, :4] * sign) / np.sqrt(e[:4])
    sums = np.unique(x, axis=0).sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    want = {(r[0], k + 1, int(deviation[i])): y[i, k] for i, r in enumerate(good) for k in range(4)}
    for r in out:
        assert r.n == n and abs(r.whitened - want[r.vec_id, r.component, int(r.deviation)]) < 1e-9
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12 and r.identity_error < 1e-10


def test_exact_deviations_beyond_64_bits():
    mean = Mean(10**11 + 7, [10**12 + 3, -5 * 10**12])
    x = np.array([[90, -77], [300, 3], [2**40, 3]], np.int64)
    high, low = mean.deviations(x)
    assert high[2] is None
    for row, h, lo in zip(x[:2].tolist(), high.tolist(), low.tolist()):
        assert h * 2**32 + lo == sum((mean.n * c - s) ** 2 for c, s in zip(row, mean.sums))


@pytest.mark.parametrize("rows, components", [([], 0), ([[1.0, 2.0]] * 5, 0), ([[1.0, 2.0], [3.0, 2.0]], 1), ([[], []], 0)])
def test_little_variance(spark, rows, components):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    model = fit_whitening(df)
    assert len(model.values) == components
    assert whiten(df, model).count() == components * len(rows)
