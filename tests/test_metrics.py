import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from cohortica.operators import metrics as M
from cohortica.operators import profile as P


def auc(y, p, w=None):
    y, p = np.asarray(y), np.asarray(p, float)
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    pos, neg = y == 1, y == 0
    wins = (p[pos][:, None] > p[neg][None]) + 0.5 * (p[pos][:, None] == p[neg][None])
    return float((w[pos][:, None] * w[neg][None] * wins).sum() / (w[pos].sum() * w[neg].sum()))


def average_precision(y, p):
    order = np.argsort(-np.asarray(p), kind="stable")
    y, p = np.asarray(y)[order], np.asarray(p)[order]
    ends = np.r_[np.flatnonzero(np.diff(p)), len(p) - 1]
    tp = np.cumsum(y)[ends]
    return float(np.sum(np.diff(np.r_[0, tp]) / y.sum() * tp / (ends + 1)))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    n = 2500
    pdf = pd.DataFrame({"mes": np.where(rng.random(n) < 0.7, 1, rng.integers(2, 5, n)),
                        "score": np.where(rng.random(n) < 0.4, 0.5, np.round(rng.random(n), 3)),
                        "objetivo": (rng.random(n) < 0.3).astype(int), "w": rng.integers(0, 4, n)})
    return pdf, spark.createDataFrame(pdf).cache()


def test_gini_fixture(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "objetivo int, score double")
    row = M.auc_table(df, []).first()
    assert row.gini == pytest.approx(0.5) and row.n_rows == 4 and row.events == 2


def test_auc_and_ap_match_pair_counting(scored):
    pdf, df = scored
    got = {r.mes: r for r in M.metric_table(df, ["mes"]).collect()}
    for m, part in pdf.groupby("mes"):
        assert got[m].auc == pytest.approx(auc(part.objetivo, part.score), abs=1e-12)
        assert got[m].ap == pytest.approx(average_precision(part.objetivo, part.score), abs=1e-12)


def test_weighted_auc_equals_repeated_rows(spark):
    df = spark.createDataFrame(list(zip([0, 1, 0, 1, 1, 0], [.1, .1, .6, .8, .6, .6], [0, 1, 0, 2, 1, 2])),
                               "objetivo int, score double, id long")
    counts = spark.createDataFrame([(0, 2), (1, 3), (2, 1)], "id long, w int")
    joined = df.join(counts, "id")
    repeated = joined.withColumn("k", F.explode(F.sequence(F.lit(1), "w")))
    a = M.auc_table(joined, [], weight="w").first().auc
    assert a == pytest.approx(M.auc_table(repeated, []).first().auc, abs=1e-15)


def test_weighted_auc_matches_brute_force(scored):
    pdf, df = scored
    got = {r.mes: r.auc for r in M.auc_table(df, ["mes"], weight="w").collect()}
    for m, part in pdf.groupby("mes"):
        assert got[m] == pytest.approx(auc(part.objetivo, part.score, part.w), abs=1e-12)


def test_gini_is_invariant_under_monotone_maps(scored):
    _, df = scored
    a = {r.mes: r.gini for r in M.auc_table(df, ["mes"]).collect()}
    b = {r.mes: r.gini for r in M.auc_table(df.withColumn("score", F.exp("score") * 3), ["mes"]).collect()}
    assert a == b


def test_single_class_is_null_or_an_error(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 0, 0.2), (2, 0, 0.1), (2, 1, 0.5)], "mes int, objetivo int, score double")
    table = M.auc_table(df, ["mes"])
    assert {r.mes: r.gini for r in table.collect()} == {1: None, 2: 1.0}
    with pytest.raises(Exception, match="single class"):
        M.require_both_classes(table).collect()
    with pytest.raises(Exception, match="undefined"):
        M.monthly_summary(table).collect()
    row = M.monthly_summary(table, undefined="report").first()
    assert (row.n_periods, row.undefined_periods, row.mean_gini) == (1, 1, 1.0)


@pytest.mark.parametrize("row", [(1, 0, None), (1, 0, float("nan")), (1, 2, 0.5), (1, None, 0.5)])
def test_bad_scores_and_labels_are_refused(spark, row):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.2), row], "mes int, objetivo int, score double")
    with pytest.raises(Exception, match="NULL or NaN|not 0 or 1"):
        M.auc_table(df, ["mes"]).collect()


def test_summary_uses_population_std_unless_asked(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.4)], "mes int, gini double")
    assert M.monthly_summary(df).first().std_gini == pytest.approx(0.1)
    assert M.monthly_summary(df, ddof=1).first().std_gini == pytest.approx(np.std([0.2, 0.4], ddof=1))


def test_ks_distance(spark):
    x = np.random.default_rng(0).beta(2, 3, 400).round(2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    s = np.sort(x)
    i = np.arange(1, 401)
    want = max((i / 400 - s).max(), (s - (i - 1) / 400).max())
    row = M.ks_uniform(df, "x").withColumn("p", M.ks_pvalue(F.col("ks"), F.col("n_rows"))).first()
    assert row.ks == pytest.approx(want, abs=1e-12)
    assert 0 <= row.p < 1e-6


def test_correlations(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 300), "b": rng.normal(size=300)})
    pdf["b"] += pdf.a
    row = M.correlation(spark.createDataFrame(pdf), "a", "b").first()
    assert row.pearson == pytest.approx(pdf.a.corr(pdf.b), abs=1e-12)
    assert row.spearman == pytest.approx(pdf.a.rank().corr(pdf.b.rank()), abs=1e-12)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert M.correlation(df, "a", "b").first().pearson is None


def test_check_scores_counts_problems(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 1.5), (2, float("nan")), (1, None)], "objetivo int, p double")
    row = M.check_scores(df, "p", "objetivo").first()
    assert (row.n_rows, row.bad_scores, row.bad_labels) == (4, 3, 1)


def cramers(t):
    t = np.asarray(t, float)
    n = t.sum()
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / n
    gap = np.abs(t - e)
    if t.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    return float(np.sqrt((gap ** 2 / e).sum() / (n * (min(t.shape) - 1))))


@pytest.mark.parametrize("table", [
    [[10, 4], [3, 9]], [[10, 0], [3, 9]], [[7, 0], [0, 5]], [[5, 0, 2], [0, 6, 1]], [[3, 1, 4], [1, 5, 9], [2, 6, 0]]])
def test_cramers_v_with_empty_cells(spark, table):
    data = [(f"r{i}", f"c{j}") for i, row in enumerate(table) for j, n in enumerate(row) for _ in range(n)]
    got = P.cramers_v(spark.createDataFrame(data, "a string, b string"), ["a", "b"]).first().cramers_v
    assert got == pytest.approx(cramers(table), abs=1e-12)
