"""Hazard tables and models."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from cohortica.functions.periods import ordinal
from cohortica.functions.stored import stored
from cohortica.operators import history as H
from cohortica.operators import metrics as M
from cohortica.operators import survival as S
from cohortica.plans import newton_sql as N
from cohortica.plans.panel import PANEL_SQL, gini_sql, panel
from cohortica.plans.q_features import ENTITY_WINDOW, K, KEYS, rounded
from cohortica.plans.registry import query

THROUGH, VALID = 199812, 199901
INTERVALS_SQL = PANEL_SQL + f""",
iv AS (SELECT *, CAST(ord - min(ord) OVER u AS INT) AS start, CAST(ord - min(ord) OVER u + 1 AS INT) AS stop FROM panel {ENTITY_WINDOW}),
tr AS (SELECT *, lead(mes) OVER w IS NULL AND objetivo = 0 AS cens FROM iv WHERE mes <= {THROUGH} WINDOW w AS (PARTITION BY id_cliente ORDER BY mes)),
va AS (SELECT * FROM iv WHERE mes = {VALID})"""


def intervals(spark, sf_dir):
    """Training intervals from training rows only, and the validation month's intervals."""
    df = panel(spark, sf_dir)
    train = H.risk_intervals(df.where(F.col("mes") <= THROUGH))
    valid = H.risk_intervals(df.where(F.col("mes") <= VALID)).where(F.col("mes") == VALID)
    return train, valid


@query("a31_risk_audit", INTERVALS_SQL + """
SELECT (SELECT count(*) FROM va WHERE stop > (SELECT max(stop) FROM tr)) AS beyond_tenure, count(*) AS risk_rows,
  CAST(sum(objetivo) AS BIGINT) AS events, CAST(sum(cens::INT) AS BIGINT) AS censored FROM tr""")
def risk_audit(spark, sf_dir):
    return S.risk_audit(*intervals(spark, sf_dir))


@query("a31_hazard_by_tenure", INTERVALS_SQL + """
SELECT stop, count(*) AS at_risk, CAST(sum(objetivo) AS BIGINT) AS events, round(avg(objetivo), 9) AS hazard FROM tr GROUP BY 1""")
def hazard_by_tenure(spark, sf_dir):
    return rounded(S.hazard_by_tenure(intervals(spark, sf_dir)[0]))


@query("m8_breslow_baseline", INTERVALS_SQL + f""",
rk AS (SELECT stop, objetivo, exp((edad - 40) * 0.01::DOUBLE) AS r FROM tr), inc AS (SELECT stop, sum(objetivo) / sum(r) AS h FROM rk GROUP BY 1)
SELECT id_cliente, mes, round(1 - exp(-h * exp((edad - 40) * 0.01::DOUBLE)), 9) AS probability FROM va JOIN inc ON inc.stop = least(va.stop, (SELECT max(stop) FROM inc))""")
def breslow_baseline(spark, sf_dir):
    """M8 for given coefficients."""
    train, valid = intervals(spark, sf_dir)
    risk = F.exp((F.col("edad") - 40) * F.lit(0.01))
    inc = S.breslow_increments(train.withColumn("_risk", risk), "_risk")
    return rounded(S.cox_probability(valid.withColumn("_risk", risk), inc, "_risk").select(*KEYS, "probability"))


# Training months up to the first of each pair, validation in the second.
CUTS = [(199812, 199901), (199901, 199902), (199902, 199903)]
NUMERIC = ["edad", "ingresos", "ratio_deuda_ingresos", "numero_productos", "saldo_promedio", "dias_ultima_transaccion",
           "dias_ultima_interaccion", "antiguedad_direccion_meses", "visitas_web_ultimos_90_dias", "distancia_sucursal_km",
           "dia_preferido_pago", "tiene_tarjeta_credito", "activo_movil", "es_nuevo_cliente", "tiene_prestamo",
           "tiene_seguro", "mes_ordinal"]
# Category levels of the panel, in order.
LEVELS = {
    "ocupacion": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
    "canal_adquisicion": ["app", "branch", "referral", "web"],
    "banda_riesgo": ["high", "low", "medium"],
    "dispositivo_principal": ["android", "desktop", "ios", "other"],
}
FITS_SQL = PANEL_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
cuts AS (SELECT * FROM (VALUES {', '.join(map(str, CUTS))}) t(through, cut)),
hz AS (SELECT cut, mes <= through AS train, id_cliente, mes, objetivo, objetivo AS y, 1.0::DOUBLE AS w, ord AS mes_ordinal,
  CAST(ord - min(ord) OVER (PARTITION BY cut, id_cliente) + 1 AS INT) AS stop, {', '.join(c for c in [*NUMERIC[:-1], *LEVELS])}
  FROM panel JOIN cuts ON mes <= cut),
{N.design_sql('hz', NUMERIC, LEVELS, 'xr')},
{N.design_sql('hz', NUMERIC, LEVELS, 'xi', intercept=True)},
lt AS (SELECT cut, max(stop) AS longest FROM hz WHERE train GROUP BY cut)"""
WIDTH = N.width(NUMERIC, LEVELS)
COX_SQL = FITS_SQL + ",\n" + N.cox_sql("xr", WIDTH, S.COX_RIDGE, 9) + """,
ri AS (SELECT xr.*, exp(list_dot_product(x, b)) AS risk FROM xr JOIN nw_fit USING (cut)),
ic AS (SELECT cut, stop, sum(y) / sum(risk) AS inc FROM ri WHERE train GROUP BY cut, stop),
pv AS (SELECT ri.cut, id_cliente, ri.mes, objetivo, 1 - exp(-coalesce(inc, 0) * risk) AS p
  FROM ri JOIN lt USING (cut) LEFT JOIN ic ON ic.cut = ri.cut AND ic.stop = least(ri.stop, longest) WHERE ri.mes = ri.cut)"""
CLOGLOG_SQL = FITS_SQL + ",\n" + N.glm_sql("xi", WIDTH, N.CLOGLOG, str(S.CLOGLOG_RIDGE), 25, tenure=True) + """,
pv AS (SELECT xi.cut, id_cliente, xi.mes, objetivo, 1 - exp(-exp(list_dot_product(x, b) + t[least(stop, longest)])) AS p
  FROM xi JOIN nw_fit USING (cut) JOIN lt USING (cut) WHERE xi.mes = xi.cut)"""
GINI_OF_P = f""",
{gini_sql('pv', 'mes', 'p')} SELECT mes, n_rows, events, round(auc, 6) AS auc, round(gini, 6) AS gini FROM g"""
PROBABILITIES = f" SELECT {K}, round(p, 6) AS probability FROM pv"


def cut_scores(spark, sf_dir, scorer):
    """Scores of the validation month of every cut, fitted on the months before it."""
    df = stored(panel(spark, sf_dir, max(v for _, v in CUTS)).withColumn("mes_ordinal", ordinal("mes")), "panel")

    def fit(cut):
        through, month = cut
        train = H.risk_intervals(df.where(F.col("mes") <= through))
        valid = H.risk_intervals(df.where(F.col("mes") <= month)).where(F.col("mes") == month)
        return scorer(train, valid, NUMERIC, list(LEVELS))

    with ThreadPool(len(CUTS)) as pool:                     # the fits are independent: their jobs share the cluster
        return reduce(lambda a, b: a.unionByName(b), pool.map(inheritable_thread_target(spark)(fit), CUTS))


def cut_ginis(scored):
    table = M.auc_table(scored, ["mes"], "prediccion", probability=True)
    return table.select("mes", "n_rows", "events", F.round("auc", 6).alias("auc"), F.round("gini", 6).alias("gini"))


@query("m7_cox_gini", COX_SQL + GINI_OF_P)
def cox_gini(spark, sf_dir):
    """M7: all covariates, three cuts; Gini of each validation month."""
    return cut_ginis(cut_scores(spark, sf_dir, S.score_cox))


@query("m7_cox_probabilities", COX_SQL + PROBABILITIES)
def cox_probabilities(spark, sf_dir):
    out = cut_scores(spark, sf_dir, S.score_cox)
    return out.select(*KEYS, F.round("prediccion", 6).alias("probability"))


@query("m6_cloglog_gini", CLOGLOG_SQL + GINI_OF_P)
def cloglog_gini(spark, sf_dir):
    """M6: discrete hazard with an effect of each month of tenure, all covariates, three cuts."""
    return cut_ginis(cut_scores(spark, sf_dir, S.score_cloglog))


@query("m6_cloglog_probabilities", CLOGLOG_SQL + PROBABILITIES)
def cloglog_probabilities(spark, sf_dir):
    out = cut_scores(spark, sf_dir, S.score_cloglog)
    return out.select(*KEYS, F.round("prediccion", 6).alias("probability"))
