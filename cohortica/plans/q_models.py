"""Propensity models evaluated over time. Fits have no SQL equivalent except by counting."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cohortica.functions import features as X
from cohortica.functions.periods import month_index
from cohortica.operators import history as H
from cohortica.operators import metrics as M
from cohortica.operators import models as MOD
from cohortica.operators import splits as S
from cohortica.plans import newton_sql as N
from cohortica.plans.panel import CUTS, PANEL_SQL, RISK_BANDS, SCORE_MONTH, TRAIN_THROUGH, gini_sql, panel
from cohortica.plans.q_features import ENTITY_WINDOW, K, KEYS, rounded
from cohortica.plans.q_metrics import rank_sql
from cohortica.plans.q_splits import hash_int_sql, uniform_sql
from cohortica.plans.q_survival import LEVELS
from cohortica.plans.registry import query
from cohortica.spec import BOOLEAN_COLUMNS, CATEGORICAL_COLUMNS, NUMERIC_COLUMNS

# Every column of the published schema; flags enter as 0/1 numbers.
NUM = tuple(NUMERIC_COLUMNS) + tuple(BOOLEAN_COLUMNS)
CAT = tuple(CATEGORICAL_COLUMNS)
LAST_VALID = CUTS[-1][1]
GBT = MOD.ModelSpec("gbt", "gbt", NUM, CAT, {"maxIter": 5, "maxDepth": 3})
LOGISTIC = MOD.ModelSpec("logistic", "logistic", NUM, CAT, {"C": 1.0})
# Rounds end where the validation loss stops falling, far below this many; a flat loss ends them too.
STOPPED = replace(GBT, params={**GBT.params, "maxIter": 1600, "validationTol": 1e-5})
INNER_FOLDS = [(199808, 199809), (199809, 199810), (199810, 199811), (199811, 199812)]
FIT_PANEL_SQL = PANEL_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
CUTS_SQL = f"cuts AS (SELECT * FROM (VALUES {', '.join(map(str, CUTS))}) t(through, month))"
NAMES = ", ".join([*NUM, *CAT])
METRICS_SQL = "SELECT {by}, n_rows, events, round(auc, 6) AS auc, round(gini, 6) AS gini, round(ap, 6) AS ap FROM g"


def linear_sql(rows: str, numeric=NUM, levels=LEVELS, c: float = 1.0, extra: str = "") -> str:
    """CTEs up to ``pv``: probabilities ``p`` of the rows that are not for training, of every ``cut``.

    ``rows`` defines ``lr``: cut, train, w, label, the features, and what else the query needs.
    """
    numeric = list(numeric)
    d = len(numeric) + sum(map(len, levels.values()))
    return FIT_PANEL_SQL + f""",
{CUTS_SQL}, {rows},
ly AS (SELECT *, objetivo AS y FROM lr), {N.one_hot_sql('ly', numeric, levels)},
{N.glm_sql('xl', d, N.LOGIT, f'1.0 / ({c} * c.n_rows)', 8)},
pv AS (SELECT xl.* EXCLUDE (x), 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM xl JOIN nw_fit USING (cut) WHERE NOT train)"""


def rolling_sql(columns: str = NAMES, weight: str = "1.0::DOUBLE", window: str = "true", source: str = "panel") -> str:
    return f"""lr AS (SELECT month AS cut, mes <> month AS train, {weight} AS w, id_cliente, mes, objetivo, {columns}
  FROM {source} panel JOIN cuts ON mes = month OR (mes <= through AND {window}))"""


def model_metrics_sql(model: str) -> str:
    return f", {gini_sql('pv', 'mes', 'p')} " + METRICS_SQL.format(by=f"'{model}' AS model, mes")


def frame(spark, sf_dir, through=LAST_VALID):
    return panel(spark, sf_dir, through).select(*KEYS, "objetivo", *NUM, *CAT)


def metrics(oof):
    return rounded(MOD.fold_metrics(oof), 6)


@query("m1_boosted_trees")
def boosted_trees(spark, sf_dir):
    """M1 and M10."""
    return metrics(MOD.rolling_oof(frame(spark, sf_dir), CUTS, GBT))


@query("m2_logistic", linear_sql(rolling_sql()) + model_metrics_sql("logistic"))
def logistic(spark, sf_dir):
    return metrics(MOD.rolling_oof(frame(spark, sf_dir), CUTS, LOGISTIC))


@query("m2_logistic_probabilities", linear_sql(rolling_sql()) + f"SELECT {K}, round(p, 6) AS prediccion FROM pv")
def logistic_probabilities(spark, sf_dir):
    return rounded(MOD.rolling_oof(frame(spark, sf_dir), CUTS, LOGISTIC).select(*KEYS, "prediccion"), 6)


BINNED = MOD.ModelSpec("binned_logistic", "binned_logistic", NUM, CAT, {"C": 0.1, "bins": 10})
CROSSED = MOD.ModelSpec("crossed_logistic", "crossed_logistic", NUM, ("banda_riesgo",), {"C": 0.05, "bins": 4})


@query("m3_binned_logistic")
def binned_logistic(spark, sf_dir):
    return metrics(MOD.rolling_oof(frame(spark, sf_dir), CUTS, BINNED))


@query("m4_crossed_logistic")
def crossed_logistic(spark, sf_dir):
    """Every number's bins crossed with the risk band, as a sparse design."""
    return metrics(MOD.rolling_oof(frame(spark, sf_dir), CUTS, CROSSED))


RULES_SQL = """rl AS (SELECT id_cliente, mes, objetivo, lo::INT AS r1, hi::INT AS r2, (lo AND np >= 3)::INT AS r3, (lo AND mc AND np >= 2)::INT AS r4,
  lo::INT * (dt / 365.0::DOUBLE) AS r5, (hi AND dt < 100)::INT AS r6, (hi AND dt < 180)::INT AS r7, (hi AND dt >= 180 AND canal_adquisicion = 'branch')::INT AS r8,
  me::INT * (dt / 365.0::DOUBLE) AS r9, ln(kk) AS r10, ((lo OR me) AND ratio_deuda_ingresos >= 0.6)::INT AS r11, (saldo_promedio <= 300)::INT AS r12
  FROM (SELECT *, row_number() OVER (PARTITION BY id_cliente ORDER BY mes) AS kk, banda_riesgo = 'low' AS lo, banda_riesgo = 'high' AS hi,
    banda_riesgo = 'medium' AS me, activo_movil AND tiene_tarjeta_credito AS mc, dias_ultima_transaccion AS dt, numero_productos AS np FROM panel))"""
RULE_NAMES = [f"r{i}" for i in range(1, 13)]


@query("m4_rule_logistic", linear_sql(RULES_SQL + ", " + rolling_sql(", ".join(RULE_NAMES), source="rl"), RULE_NAMES, {})
       + model_metrics_sql("rules"))
def rule_logistic(spark, sf_dir):
    rules = X.rule_flags("kk")
    df = panel(spark, sf_dir, LAST_VALID).withColumn("kk", H.months_in_panel()).select(
        *KEYS, "objetivo", *[e.alias(n) for n, e in rules.items()])
    return metrics(MOD.rolling_oof(df, CUTS, MOD.ModelSpec("rules", "rules", tuple(rules))))


NB_COLS = list(CAT)


def nb_sql(group: str) -> str:
    parts = [f"""
c{i} AS (SELECT {group} AS g, {c} AS v, count(*) AS m, sum(objetivo) AS m1 FROM tr GROUP BY 1, 2),
k{i} AS (SELECT count(DISTINCT {c}) AS k FROM tr)""" for i, c in enumerate(NB_COLS)]
    term = " + ".join(
        f"ln((coalesce(c{i}.m1, 0) + 1.0::DOUBLE) / (n1 + (SELECT k FROM k{i}))) - ln((coalesce(c{i}.m - c{i}.m1, 0) + 1.0::DOUBLE) / (n - n1 + (SELECT k FROM k{i})))"
        for i in range(len(NB_COLS)))
    joins = " ".join(f"LEFT JOIN c{i} ON c{i}.g = s.g AND c{i}.v = s.{c}" for i, c in enumerate(NB_COLS))
    return PANEL_SQL + f""", tr AS (SELECT * FROM panel WHERE mes <= 199812), cl AS (SELECT {group} AS g, count(*) AS n, CAST(sum(objetivo) AS DOUBLE) AS n1 FROM tr GROUP BY 1),
s AS (SELECT *, {group} AS g FROM panel WHERE mes = 199901),{','.join(parts)}
SELECT s.id_cliente, s.mes, round(1 / (1 + exp(-(ln(n1 / (n - n1)) + {term}))), 9) AS prediccion FROM s JOIN cl ON cl.g = s.g {joins}"""


@query("m5_naive_bayes", nb_sql("'all'"))
def naive_bayes(spark, sf_dir):
    df = panel(spark, sf_dir)
    return rounded(MOD.naive_bayes(df.where(F.col("mes") <= 199812), df.where(F.col("mes") == 199901), NB_COLS))


@query("m5_naive_bayes_by_band", nb_sql("banda_riesgo"))
def naive_bayes_by_band(spark, sf_dir):
    df = panel(spark, sf_dir)
    return rounded(MOD.naive_bayes(df.where(F.col("mes") <= 199812), df.where(F.col("mes") == 199901),
                                   NB_COLS, by="banda_riesgo"))


@query("m9_tree_leaves")
def tree_leaves(spark, sf_dir):
    df = frame(spark, sf_dir)
    out = None
    for band in RISK_BANDS:
        part = MOD.tree_leaves(df.where(F.col("banda_riesgo") == band), NUM, "objetivo", 3, 200).withColumn(
            "band", F.lit(band))
        out = part if out is None else out.unionByName(part)
    return out


@query("m11_iteration_selection")
def iteration_selection(spark, sf_dir):
    """Median early-stopped rounds over four inner folds, then the metrics at that length."""
    oof, rounds = MOD.selected_rounds_oof(frame(spark, sf_dir), INNER_FOLDS, CUTS, STOPPED, "gbt_selected")
    return metrics(oof).withColumn("rounds", F.lit(rounds))


@query("m12_grid_search")
def grid_search(spark, sf_dir):
    grid = MOD.parameter_grid({"maxDepth": [2, 3], "stepSize": [0.1]})
    base = MOD.ModelSpec("gbt", "gbt", NUM, CAT, {"maxIter": 3})
    return MOD.grid_search(frame(spark, sf_dir), INNER_FOLDS, base, grid)


@query("m13_seed_bagging")
def seed_bagging(spark, sf_dir):
    spec = MOD.ModelSpec("bag", "gbt", NUM, CAT, {"maxIter": 3, "maxDepth": 3}, seeds=(42, 43))
    return metrics(MOD.rolling_oof(frame(spark, sf_dir), CUTS, spec))


@query("m14_final_fit_score", linear_sql(f"""lr AS (SELECT 0 AS cut, mes <= {TRAIN_THROUGH} AS train, 1.0::DOUBLE AS w, id_cliente, mes, objetivo, {NAMES}
  FROM panel WHERE mes <= {TRAIN_THROUGH} OR mes = {SCORE_MONTH})""") + f"SELECT {K}, round(p, 6) AS prediccion FROM pv")
def final_fit_score(spark, sf_dir):
    """Fit on every labelled month, score the next one."""
    df = frame(spark, sf_dir, SCORE_MONTH)
    out = MOD.fit_score(df.where(F.col("mes") <= TRAIN_THROUGH), df.where(F.col("mes") == SCORE_MONTH), LOGISTIC)
    return rounded(out.select(*KEYS, "prediccion"), 6)


@query("m15_permutation_importance")
def permutation_importance(spark, sf_dir):
    df = frame(spark, sf_dir)
    model = MOD.fit(df.where(F.col("mes") <= 199812), LOGISTIC)
    return MOD.permutation_importance(model, df.where(F.col("mes") == 199901), LOGISTIC,
                                      list(NUM + CAT), 7)


@query("m16_gain_importance")
def gain_importance(spark, sf_dir):
    train = frame(spark, sf_dir).where(F.col("mes") <= 199812)
    return MOD.gain_importance([MOD.fit(train, GBT, s) for s in (42, 43)], GBT, spark)


WINDOWS_SQL = linear_sql(f"""lr AS (SELECT arm || '-' || month AS cut, arm, mes <> month AS train, 1.0::DOUBLE AS w, id_cliente, mes, objetivo, {NAMES}
  FROM panel JOIN cuts ON mes <= month, (VALUES ('expanding'), ('sliding')) a(arm)
  WHERE mes = month OR (mes <= through AND (arm = 'expanding' OR ord > (through // 100) * 12 + through % 100 - 1 - 3)))""")


@query("m17_window_comparison", WINDOWS_SQL + f", {gini_sql('pv', 'arm, mes', 'p')} " + METRICS_SQL.format(by="arm AS model, mes"))
def window_comparison(spark, sf_dir):
    return rounded(MOD.compare_windows(frame(spark, sf_dir), CUTS, LOGISTIC), 6)


FOLDS_SQL = linear_sql(f"""fo AS (SELECT arm || '-' || k AS cut, arm, CAST(k AS INT) AS fold, CASE arm WHEN 'client' THEN {hash_int_sql(1, 'id_cliente')} % 3
    ELSE {hash_int_sql(2, 'id_cliente', 'mes')} % 3 END <> k AS train, CASE WHEN arm = 'row_id' THEN id_cliente ELSE 0 END AS id_feature, *
  FROM panel, (VALUES ('client'), ('row'), ('row_id')) a(arm), range(3) f(k) WHERE mes <= {LAST_VALID}),
lr AS (SELECT cut, arm, fold, train, 1.0::DOUBLE AS w, id_cliente, mes, objetivo, id_feature, {NAMES} FROM fo)""", (*NUM, "id_feature"))


@query("m17_random_fold_comparison", FOLDS_SQL + f", {gini_sql('pv', 'arm, fold', 'p')} "
       "SELECT arm, fold, n_rows, events, round(auc, 6) AS auc, round(gini, 6) AS gini FROM g")
def random_fold_comparison(spark, sf_dir):
    """Folds of clients, of rows, and of rows with the client number as a feature."""
    folded = S.hash_folds(frame(spark, sf_dir), 3, ["id_cliente"], 1).withColumnRenamed("fold", "client_fold")
    folded = S.hash_folds(folded, 3, ["id_cliente", "mes"], 2).withColumnRenamed("fold", "row_fold").withColumn(
        "id_feature", F.col("id_cliente"))
    with_id = replace(LOGISTIC, numeric=(*NUM, "id_feature"))
    return rounded(MOD.cross_validate(folded, {"client": ("client_fold", LOGISTIC), "row": ("row_fold", LOGISTIC),
                                               "row_id": ("row_fold", with_id)}, 3), 6)


CURVE, CURVE_SEEDS = [0.25, 0.5, 0.75, 1.0], [5, 6, 7]
CURVE_SQL = linear_sql(f"""lr AS (SELECT fraction || '-' || seed || '-' || month AS cut, fraction, seed, mes <> month AS train, 1.0::DOUBLE AS w, id_cliente, mes, objetivo, {NAMES}
  FROM panel JOIN cuts ON mes <= month, (VALUES {', '.join(f'({f}::DOUBLE)' for f in CURVE)}) a(fraction), (VALUES {', '.join(f'(CAST({s} AS INT))' for s in CURVE_SEEDS)}) b(seed)
  WHERE (fraction < 1 OR seed = {CURVE_SEEDS[0]}) AND (mes = month OR (mes <= through AND CASE seed {' '.join(
      f"WHEN {s} THEN {uniform_sql(s, 'id_cliente')}" for s in CURVE_SEEDS)} END < fraction)))""")


@query("m18_learning_curve", CURVE_SQL + f", {gini_sql('pv', 'fraction, seed, mes', 'p')} "
       "SELECT fraction, seed, mes, n_rows, events, round(auc, 6) AS auc, round(gini, 6) AS gini FROM g")
def learning_curve(spark, sf_dir):
    """Three repetitions of every share below the whole, three cuts."""
    return rounded(MOD.learning_curve(frame(spark, sf_dir), CUTS, LOGISTIC, CURVE, CURVE_SEEDS), 6, ("fraction",))


VARIANTS_SQL = linear_sql(f"""hs AS (SELECT *, row_number() OVER w - 1 AS previas, ord - min(ord) OVER (PARTITION BY id_cliente) AS entrada FROM panel {ENTITY_WINDOW}),
lr AS (SELECT variant || '-' || month AS cut, variant, month, mes <= through AS train, 1.0::DOUBLE AS w, id_cliente, mes, objetivo, {NAMES},
  CASE WHEN variant IN ('B', 'D') THEN ord ELSE 0 END AS month_index, CASE WHEN variant IN ('C', 'D') THEN previas ELSE 0 END AS previas,
  CASE WHEN variant IN ('C', 'D') THEN entrada ELSE 0 END AS entrada
  FROM hs JOIN cuts ON mes <= through OR mes IN (SELECT month FROM cuts), (VALUES ('A'), ('B'), ('C'), ('D')) a(variant))""",
                          (*NUM, "month_index", "previas", "entrada")) + f""",
ev AS (SELECT variant AS model, 'rolling' AS evaluation, mes, objetivo, p FROM pv WHERE mes = month
  UNION ALL SELECT variant, 'frozen', mes, objetivo, p FROM pv WHERE month = {CUTS[0][1]}),
{gini_sql('ev', 'model, evaluation, mes', 'p')}, {gini_sql('ev', 'model, evaluation', 'p', name='pg')}
SELECT model, evaluation, count(*) AS n_periods, round(avg(g.gini), 6) AS mean_gini, round(stddev_pop(g.gini), 6) AS std_gini,
  round(any_value(pg.gini), 6) AS pooled_gini FROM g JOIN pg USING (model, evaluation) GROUP BY 1, 2"""


@query("m20_variant_ablation", VARIANTS_SQL)
def variant_ablation(spark, sf_dir):
    """Base, with the month index, with history features, with both; rolling and frozen fits."""
    df = H.add_history(frame(spark, sf_dir)).withColumn("month_index", month_index("mes", 199601))
    hist, month = ("n_observaciones_previas", "meses_desde_entrada"), ("month_index",)
    specs = [replace(LOGISTIC, name=name, numeric=NUM + extra)
             for name, extra in (("A", ()), ("B", month), ("C", hist), ("D", month + hist))]
    return rounded(MOD.ablation(df, CUTS, specs, frozen=True), 6)


DRIFT_DRAWS, DRIFT_SEED = 5, 17
DRIFT_SQL = linear_sql(f"""fu AS (SELECT *, -1 AS draw, dias_ultima_interaccion = dias_ultima_transaccion AS copied FROM panel WHERE mes <= {LAST_VALID}
  UNION ALL SELECT * REPLACE (1 + {hash_int_sql(DRIFT_SEED, 'draw', 'id_cliente', 'mes')} % 364 AS dias_ultima_interaccion)
  FROM (SELECT panel.*, CAST(r AS INT) AS draw, false AS copied FROM panel, range({DRIFT_DRAWS}) t(r) WHERE mes IN (SELECT month FROM cuts))),
fr AS (SELECT *, {rank_sql('dias_ultima_interaccion', 'draw, mes')} AS dui_rank FROM fu),
lr AS (SELECT variant || '-' || month AS cut, variant AS model, draw, copied, mes <> month AS train, 1.0::DOUBLE AS w, id_cliente, mes, objetivo,
  {', '.join(c for c in (*NUM, *CAT) if c != 'dias_ultima_interaccion')}, CASE variant WHEN 'RAW' THEN dias_ultima_interaccion WHEN 'RANK' THEN dui_rank ELSE 0 END AS dui
  FROM fr JOIN cuts ON mes = month OR (mes <= through AND draw < 0), (VALUES ('RAW'), ('RANK'), ('DROP')) a(variant))""",
                       (*[c for c in NUM if c != "dias_ultima_interaccion"], "dui")) + f""",
sl AS (SELECT *, 'all' AS slice FROM pv WHERE draw < 0 UNION ALL SELECT *, 'non_copy' FROM pv WHERE draw < 0 AND NOT copied
  UNION ALL SELECT *, 'simulated' FROM pv WHERE draw >= 0),
{gini_sql('sl', 'model, slice, draw, mes', 'p')}
SELECT model, slice, mes, round(avg(gini), 6) AS gini, max(n_rows) AS n_rows, count(gini) AS draws FROM g GROUP BY 1, 2, 3"""


@query("m21_drift_ablation", DRIFT_SQL)
def drift_ablation(spark, sf_dir):
    """A drifting column raw, ranked inside the month, or dropped: real rows, rows that are no copy, redrawn futures."""
    out = MOD.drift_ablation(frame(spark, sf_dir), CUTS, "dias_ultima_interaccion", "dias_ultima_transaccion", LOGISTIC,
                             DRIFT_DRAWS, 364, DRIFT_SEED)
    return rounded(out, 6)


@query("m10_decay_weighted_runner", linear_sql(rolling_sql(
    weight="pow(0.5::DOUBLE, ((through // 100) * 12 + through % 100 - 1 - ord) / 6.0::DOUBLE)",
    window="ord > (through // 100) * 12 + through % 100 - 1 - 24")) + model_metrics_sql("decay"))
def decay_weighted_runner(spark, sf_dir):
    """Recent window and half-life weights together."""
    return metrics(MOD.rolling_oof(frame(spark, sf_dir), CUTS, replace(LOGISTIC, name="decay", window=24, half_life=6.0)))
