import numpy as np
import pandas as pd
import pytest

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortica.operators import models as MOD, shared_fits
from cohortica.operators.logistic import fit_logistic
from cohortica.plans import q_models

CUTS = [(202603, 202604), (202604, 202605)]
LOGIT = MOD.ModelSpec("logit", "logistic", ("x", "z"), ("c",), {"C": 1.0, "maxIter": 50})


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    n = 900
    pdf = pd.DataFrame({"id_cliente": np.arange(n), "mes": rng.integers(202601, 202606, n), "x": rng.normal(size=n),
                        "z": rng.normal(size=n), "c": rng.choice(list("abc"), n)})
    p = 1 / (1 + np.exp(1 - 1.5 * pdf.x - (pdf.c == "b")))
    pdf["objetivo"] = (rng.random(n) < p).astype(int)
    return spark.createDataFrame(pdf).cache()


def test_rolling_predictions_cover_the_validation_months(panel):
    oof = MOD.rolling_oof(panel, CUTS, LOGIT)
    want = panel.where("mes in (202604, 202605)")
    assert oof.count() == want.count()
    assert want.join(oof, ["id_cliente", "mes"], "left_anti").count() == 0
    assert all(r.gini > 0.3 for r in MOD.fold_metrics(oof).collect())


def test_validation_labels_never_reach_a_fit(panel):
    flipped = panel.withColumn("objetivo", F.when(F.col("mes") >= 202604, 1 - F.col("objetivo")).otherwise(F.col("objetivo")))
    a, b = (MOD.rolling_oof(d, CUTS[:1], LOGIT).select("id_cliente", F.round("prediccion", 9).alias("p")) for d in (panel, flipped))
    assert a.exceptAll(b).count() == 0


def test_unseen_categories_are_scored(panel):
    model = MOD.fit(panel.where("c <> 'c'"), LOGIT)
    out = MOD.score(model, panel.where("c = 'c'").withColumn("c", F.lit(None).cast("string")), LOGIT, ["id_cliente"])
    assert out.where(F.col("prediccion").between(0, 1)).count() == panel.where("c = 'c'").count()


@pytest.mark.parametrize("spec", [
    MOD.ModelSpec("gbt", "gbt", ("x", "z"), ("c",), {"maxIter": 3, "maxDepth": 2}, seeds=(1, 2)),
    MOD.ModelSpec("bins", "binned_logistic", ("x", "z"), ("c",), {"bins": 5}),
    MOD.ModelSpec("decay", "logistic", ("x",), (), window=2, half_life=1.0)])
def test_other_models_rank_better_than_chance(panel, spec):
    assert MOD.fold_metrics(MOD.rolling_oof(panel, CUTS[:1], spec)).first().gini > 0.2


def test_tree_fits_read_the_panel_once(spark, panel):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    gbt = MOD.ModelSpec("gbt", "gbt", ("x", "z"), ("c",), {"maxIter": 2, "maxDepth": 2})
    df = panel.coalesce(2).withColumn("x", F.udf(seen, "double")("x"))
    assert 1 <= MOD.select_iterations(df, [(202602, 202603), *CUTS], gbt) <= 2
    assert read.value == 900                                              # once, not once a fold and stage
    MOD.rolling_oof(df, CUTS, gbt).count()
    assert read.value == 2 * 900


def test_shared_tree_rows_give_the_trees_of_single_fits(panel):
    df = panel.coalesce(3).withColumn("c", F.when((F.col("mes") == 202604) & (F.col("z") > 0), "a0").otherwise(F.col("c")))
    gbt = MOD.ModelSpec("gbt", "gbt", ("x", "z"), ("c",), {"maxIter": 2, "maxDepth": 3}, seeds=(1,))
    shared = {tuple(r) for r in MOD.rolling_oof(df, CUTS, gbt).select("id_cliente", "mes", F.round("prediccion", 12)).collect()}
    single = set()
    for through, month in CUTS:                                           # the first fit has never seen a0
        part = MOD.fit_score(df.where(F.col("mes") <= through), df.where(F.col("mes") == month), gbt)
        single |= {tuple(r) for r in part.select("id_cliente", "mes", F.round("prediccion", 12)).collect()}
    assert shared == single
    oof, rounds = MOD.selected_rounds_oof(df, [(202602, 202603)], CUTS, gbt, "chosen")
    assert rounds == MOD.select_iterations(df, [(202602, 202603)], gbt) and {r.model for r in oof.collect()} == {"chosen"}
    wide = MOD.ModelSpec("wide", "gbt", ("x", "z"), ("c",), {"maxIter": 1, "maxDepth": 2, "maxBins": 4}, seeds=(1,))
    assert MOD.rolling_oof(df, CUTS, wide).count() == len(shared)         # more levels than bins: fits keep their own codes


def naive(train, rows, cols, unseen_first=False):
    out = []
    for _, r in rows.iterrows():
        z = np.log(train.objetivo.sum() / (1 - train.objetivo).sum())
        for c in cols:
            values = sorted(train[c].unique())
            v = values[0] if unseen_first and r[c] not in values else r[c]
            for y, sign in ((1, 1), (0, -1)):
                part = train[train.objetivo == y]
                z += sign * np.log(((part[c] == v).sum() + 1) / (len(part) + len(values)))
        out.append(1 / (1 + np.exp(-z)))
    return np.array(out)


@pytest.mark.parametrize("clip", [False, True])
def test_naive_bayes_matches_counting(spark, panel, clip):
    pdf = panel.toPandas()
    pdf["d"] = np.where(pdf.x > 0, "hi", "lo")
    train, rows = pdf[pdf.mes < 202605], pdf[pdf.mes == 202605].sort_values("id_cliente").copy()
    rows.loc[rows.index[:5], "c"] = "new"
    got = MOD.naive_bayes(spark.createDataFrame(train), spark.createDataFrame(rows), ["c", "d"], clip_unseen=clip).toPandas()
    np.testing.assert_allclose(got.sort_values("id_cliente").prediccion, naive(train, rows, ["c", "d"], clip), atol=1e-12)


def test_permuting_the_used_column_costs_most(panel):
    model = MOD.fit(panel.where("mes <= 202604"), LOGIT)
    drops = {r.feature: r.mean_drop for r in MOD.permutation_importance(
        model, panel.where("mes = 202605"), LOGIT, ["x", "z"], 3).collect()}
    assert drops["x"] > drops["z"] + 0.1


def test_grid_and_leaves(panel):
    assert MOD.parameter_grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    base = MOD.ModelSpec("g", "gbt", ("x",), (), {"maxDepth": 2})
    table = MOD.grid_search(panel, CUTS[:1], base, MOD.parameter_grid({"maxIter": [1, 4]})).collect()
    assert len(table) == 2 and table[0].mean_gini >= table[1].mean_gini
    leaves = MOD.tree_leaves(panel, ["x"], "objetivo", 2, 50).collect()
    assert sum(r.n_rows for r in leaves) == 900 and min(r.n_rows for r in leaves) >= 50


def test_logistic_newton_reaches_the_weighted_optimum(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(300, 4)), rng.random(300) + 0.5
    x[:, 3] = x[:, 2]                                                     # the ridge parts equal columns
    y = (rng.random(300) < 1 / (1 + np.exp(1 - x[:, 0]))).astype(float)
    rows = [(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w)]
    df = spark.createDataFrame(rows, ["features", "y", "w"]).repartition(5)
    fit = fit_logistic(df, "y", 0.01, "w")
    full = np.column_stack([np.ones(300), x])
    beta = np.r_[fit.intercept, fit.coefficients]
    p = 1 / (1 + np.exp(-full @ beta))
    grad = full.T @ (w * (p - y)) / w.sum() + 0.01 * np.r_[0, beta[1:]]
    assert np.abs(grad).max() < 1e-9 and beta[3] == pytest.approx(beta[4])
    got = [r.probability[1] for r in fit.transform(df.coalesce(1)).collect()]
    assert sorted(got) == pytest.approx(sorted(p), abs=1e-12)
    certain = fit_logistic(df.withColumn("y", F.lit(0.0)), "y", 0.01)
    assert {r.probability[1] for r in certain.transform(df).collect()} == {0.0}


def test_medians_fill_before_edges_are_taken_and_at_scoring(panel):
    holes = panel.withColumn("x", F.when(F.col("id_cliente") % 3 > 0, F.col("x")))
    spec = MOD.ModelSpec("bins", "binned_logistic", ("x",), (), {"bins": 4})
    model = MOD.fit(holes, spec)
    pdf = holes.toPandas()
    assert model.medians["x"] == pytest.approx(pdf.x.median())
    edges = np.quantile(pdf.x.fillna(pdf.x.median()), [0.25, 0.5, 0.75])
    assert model.design.stages[0].getSplitsArray()[0][1:-1] == pytest.approx(sorted(set(edges)))
    out = {r.id_cliente: r.prediccion for r in MOD.score(model, holes, spec, ["id_cliente"]).collect()}
    assert len({round(out[i], 12) for i in pdf.id_cliente[pdf.x.isna()]}) == 1


def test_crossed_design_gives_each_band_its_own_bins(panel):
    """The effect of x flips with the band: only crossed bins can rank both."""
    flipped = panel.withColumn("objetivo", F.when(F.col("c") == "a", 1 - F.col("objetivo")).otherwise(F.col("objetivo")))
    gini = {}
    for kind in ("binned_logistic", "crossed_logistic"):
        spec = MOD.ModelSpec(kind, kind, ("x",), ("c",), {"bins": 5, "C": 1.0})
        gini[kind] = MOD.fold_metrics(MOD.rolling_oof(flipped, CUTS[:1], spec)).first().gini
    assert gini["crossed_logistic"] > gini["binned_logistic"] + 0.05


def test_all_fits_of_a_runner_share_their_passes(spark, panel, monkeypatch):
    """Nine fits take the passes of one, and each has the optimum that it has alone."""
    passes, real = [], shared_fits.keyed_sums
    monkeypatch.setattr(shared_fits, "keyed_sums", lambda *a: passes.append(1) or real(*a))
    MOD.learning_curve(panel, CUTS, LOGIT, [0.5, 1.0], [1, 2, 3, 4])
    assert 0 < len(passes) < 20
    spec = MOD.ModelSpec("decay", "logistic", ("x", "z"), ("c",), half_life=2.0)
    for kind in (LOGIT, spec, MOD.ModelSpec("bins", "binned_logistic", ("x", "z"), ("c",), {"bins": 5}),
                 MOD.ModelSpec("crossed", "crossed_logistic", ("x", "z"), ("c",), {"bins": 3})):
        got = {r.id_cliente: r.prediccion for r in MOD.rolling_oof(panel, CUTS, kind).collect()}
        for through, valid in CUTS:
            train = MOD.training_rows(panel, through, kind)
            alone = MOD.fit_score(train, panel.where(F.col("mes") == valid), kind, "_weight" if kind.half_life else None)
            assert all(got[r.id_cliente] == pytest.approx(r.prediccion, abs=1e-9) for r in alone.collect())


def test_missing_numbers_of_a_shared_fit_are_an_error(panel):
    with pytest.raises(Exception, match="NULL or NaN"):
        MOD.rolling_oof(panel.withColumn("x", F.when(F.col("id_cliente") != 5, F.col("x"))), [(202605, 202604)], LOGIT)


def test_equal_rows_tie_wherever_they_are(spark, panel):
    twice = panel.unionByName(panel.withColumn("id_cliente", F.col("id_cliente") + 1000))
    oof = MOD.rolling_oof(twice, CUTS[:1], LOGIT)
    assert oof.select("prediccion").distinct().count() == panel.where("mes = 202604").count() == oof.count() // 2


def test_selected_rounds_are_where_the_inner_folds_stop(spark, monkeypatch):
    """A signal that five shallow trees cannot hold: every inner fold stops by its validation loss, not by a limit."""
    rng = np.random.default_rng(6)
    n = 1500
    pdf = pd.DataFrame({"id_cliente": np.arange(n), "mes": rng.choice([*range(199801, 199813), 199901, 199902, 199903], n)})
    for c in q_models.NUM:
        pdf[c] = rng.normal(size=n)
    for c in q_models.CAT:
        pdf[c] = rng.choice(list("ab"), n)
    z = 2 * pdf.edad + 2 * pdf.ingresos + 2 * pdf.saldo_promedio - 1
    pdf["objetivo"] = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame(pdf).coalesce(2)
    monkeypatch.setattr(q_models, "frame", lambda *_: df)
    monkeypatch.setattr(q_models, "INNER_FOLDS", q_models.INNER_FOLDS[:1])
    out = q_models.iteration_selection(spark, "").collect()
    assert {r.mes for r in out} == {199901, 199902, 199903}
    rounds = {r.rounds for r in out}
    assert len(rounds) == 1 and 5 < rounds.pop() < q_models.STOPPED.params["maxIter"]
