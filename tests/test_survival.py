import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from cohortica.operators import history as H
from cohortica.operators import survival as S


@pytest.fixture(scope="module")
def panel(spark):
    """A small panel with an absorbing event whose hazard depends on x."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(150):
        x, band = rng.normal(), "ab"[i % 2]
        for m in range(202601, 202607):
            y = int(rng.random() < 1 / (1 + np.exp(2 - x)))
            rows.append((i, m, y, float(x), band))
            if y:
                break
    return spark.createDataFrame(rows, "id_cliente long, mes int, objetivo int, x double, band string").cache()


def test_risk_intervals_fixture(spark):
    data = [(1, 202601, 0), (2, 202601, 0), (1, 202603, 0), (1, 202604, 1), (2, 202602, 0)]
    out = {(r.id_cliente, r.mes): r for r in H.risk_intervals(
        spark.createDataFrame(data, "id_cliente long, mes int, objetivo int")).collect()}
    assert out[(1, 202603)].start == 2 and out[(1, 202604)].stop == 4
    assert sum(r.censored_last_observation for r in out.values()) == 1
    late = spark.createDataFrame([*data, (1, 202605, 0)], "id_cliente long, mes int, objetivo int")
    with pytest.raises(Exception, match="risk set"):
        H.risk_intervals(late).collect()


def cox_rows(spark, y, stop, x):
    return spark.createDataFrame([([float(v) for v in r], float(a), int(t)) for r, a, t in zip(x, y, stop)],
                                 "x array<double>, y double, stop int")


def test_cox_loss_at_zero_is_log_two(spark):
    rows = cox_rows(spark, [0, 1, 1, 0], [1, 1, 2, 2], [[1.], [2.], [0.], [1.]])
    assert S.cox_loss_gradient(rows, np.zeros(1))[0] == pytest.approx(np.log(2))


def test_cox_gradient_and_hessian_match_differences(spark):
    rng = np.random.default_rng(0)
    rows = cox_rows(spark, rng.random(40) < 0.4, rng.integers(1, 5, 40), rng.normal(size=(40, 3))).cache()
    beta, h = np.array([0.2, -0.3, 0.1]), 1e-5
    _, grad, hess = S.cox_loss_gradient(rows, beta)
    for i in range(3):
        step = np.eye(3)[i] * h
        up, down = S.cox_loss_gradient(rows, beta + step), S.cox_loss_gradient(rows, beta - step)
        assert grad[i] == pytest.approx((up[0] - down[0]) / (2 * h), abs=1e-7)
        np.testing.assert_allclose(hess[i], (up[1] - down[1]) / (2 * h), atol=1e-7)


def test_cox_fit_zeroes_the_gradient_and_ranks_risk(panel):
    iv = H.risk_intervals(panel)
    design = S.fit_design(iv, ["x"], ["band"])
    assert design.names == ["x", "band_b"]
    beta = S.fit_cox(iv, design)
    rows = iv.select(design.array().alias("x"), F.col("objetivo").cast("double").alias("y"), "stop")
    assert np.abs(S.cox_loss_gradient(rows, beta)[1]).max() < 1e-5
    assert beta[0] > 0.3


def test_design_scales_with_population_std(panel):
    pdf = panel.toPandas()
    (name, mean, std), = S.fit_design(panel, ["x"], []).numeric
    assert (name, mean, std) == ("x", pytest.approx(pdf.x.mean()), pytest.approx(pdf.x.std(ddof=0)))
    constant = S.fit_design(panel.withColumn("k", F.lit(1)), ["x", "k"], [])
    assert constant.names == ["x"]


def test_breslow_increments_and_last_carry(spark):
    train = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 1, 1.0), (2, 0, 3.0)], "stop int, objetivo int, r double")
    inc = S.breslow_increments(train, "r")
    assert {r.stop: r.increment for r in inc.collect()} == {1: pytest.approx(1 / 3), 2: pytest.approx(1 / 4)}
    valid = spark.createDataFrame([(1, 1, 2.0), (2, 9, 2.0)], "id_cliente long, stop int, r double")
    got = {r.id_cliente: r.probability for r in S.cox_probability(valid, inc, "r").collect()}
    assert got[1] == pytest.approx(1 - np.exp(-2 / 3)) and got[2] == pytest.approx(1 - np.exp(-0.5))


def test_cloglog_matches_a_newton_fit(panel):
    iv = H.risk_intervals(panel)
    design = S.fit_design(iv, ["x"], [])
    model, longest = S.fit_cloglog(iv, design)
    pdf = iv.toPandas()
    z = (pdf.x - pdf.x.mean()) / pdf.x.std(ddof=0)
    X = np.column_stack([np.ones(len(pdf)), z, *[(pdf.stop == k) for k in range(2, longest + 1)]]).astype(float)
    y, b = pdf.objetivo.to_numpy(), np.zeros(longest + 1)
    for _ in range(60):
        eta = X @ b
        mu = -np.expm1(-np.exp(eta))
        d = np.exp(eta - np.exp(eta))
        w = d * d / (mu * (1 - mu))
        b = np.linalg.solve(X.T @ (X * w[:, None]), X.T @ (w * (eta + (y - mu) / d)))
    np.testing.assert_allclose([model.intercept, *model.coefficients], b, atol=2e-3)                  # the fit has a ridge of 1e-6


def test_scored_probabilities_are_valid(panel):
    train, valid = (H.risk_intervals(panel).where(c) for c in ("mes <= 202604", "mes = 202605"))
    for fn in (S.score_cox, S.score_cloglog):
        out = fn(train, valid, ["x"], ["band"]).toPandas()
        assert len(out) == valid.count() and out.prediccion.between(0, 1).all()
        assert np.corrcoef(out.prediccion, pd.merge(out, valid.toPandas()[["id_cliente", "x"]]).x)[0, 1] > 0.5


def test_cloglog_gradient_vanishes_with_tenures_without_events(spark):
    """Tenure 3 has no event: only the ridge keeps its effect finite. The whole gradient is zero at the fit."""
    rng = np.random.default_rng(2)
    n, d, longest, ridge = 400, 3, 4, 1e-6
    x, stop = rng.normal(size=(n, d)), rng.integers(1, longest + 1, n)
    y = ((rng.random(n) < 0.2) & (stop != 3)).astype(float)
    fit = S.cloglog_newton(cox_rows(spark, y, stop, x).repartition(5), longest, d, ridge)
    full = np.column_stack([np.ones(n), x, *[(stop == k) for k in range(2, longest + 1)]]).astype(float)
    theta = np.r_[fit.intercept, fit.coefficients]
    h = np.exp(full @ theta)
    grad = full.T @ np.where(y == 1, -h / np.expm1(h), h) / n + ridge * np.r_[0, theta[1:]]
    assert np.abs(grad).max() < 1e-8 and fit.tenure[1] < -8


def test_cox_sums_do_not_overflow_for_large_predictors(spark):
    x = [[800.0], [790.0], [-900.0], [805.0]]
    rows = cox_rows(spark, [1, 0, 1, 0], [1, 1, 1, 1], x).repartition(4)
    loss, grad, hess = S.cox_loss_gradient(rows, np.array([1.0]), 0.0)
    eta = np.array([800.0, 790, -900, 805])
    e = np.exp(eta - 805)
    assert loss == pytest.approx((2 * (805 + np.log(e.sum())) - (800 - 900)) / 2)
    mean = (e * eta).sum() / e.sum()
    assert grad[0] == pytest.approx(mean - (800 - 900) / 2) and hess[0, 0] == pytest.approx((e * eta**2).sum() / e.sum() - mean**2, rel=1e-6)


def test_rows_of_a_fit_are_kept_on_disk(spark, panel, monkeypatch):
    """Neither the design rows nor their blocks fill the executors' memory, however many rows there are."""
    train = H.risk_intervals(panel)
    design, seen, real = S.fit_design(train, ["x"], ["band"]), [], S.packed

    def spy(rows):
        seen.append(rows.storageLevel)
        out = real(rows)
        seen.append(out.blocks.storageLevel)
        return out

    monkeypatch.setattr(S, "packed", spy)
    beta = S.fit_cox(train, design)
    assert len(seen) == 2 and all(level.useDisk and not level.useMemory for level in seen)
    assert beta == pytest.approx(S.newton(lambda b: (lambda v, g, h: (v, g, np.linalg.solve(h, g)))(*S.cox_loss_gradient(
        train.select(design.array().alias("x"), F.col("objetivo").alias("y"), "stop"), b)), np.zeros(2), 30, 1e-9), abs=1e-9)
