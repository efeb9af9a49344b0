"""Projections, history, trajectory, cohort, calendar, rank and encoding queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window, functions as F

from cohortica.functions import features as X
from cohortica.functions.ordered import pct_rank, pct_ranks, value_ranks
from cohortica.functions.periods import in_recent_window, month_index, ordinal, time_decay
from cohortica.operators import calendar as CAL
from cohortica.operators import encoding as E
from cohortica.operators import families as FAM
from cohortica.operators import history as H
from cohortica.plans.panel import PANEL_SQL, SCORES_SQL, TRAIN_THROUGH, panel, scores
from cohortica.plans.q_metrics import rank_sql
from cohortica.plans.registry import query
from cohortica.spec import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS

K = "id_cliente, mes"
KEYS = ["id_cliente", "mes"]
ENTITY_WINDOW = "WINDOW w AS (PARTITION BY id_cliente ORDER BY mes), u AS (PARTITION BY id_cliente ORDER BY mes ROWS UNBOUNDED PRECEDING)"


def rounded(df, digits=9, skip=()):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" and c not in skip else F.col(c)
                       for c in df.columns])


@query("p1_month_ordinal", PANEL_SQL + f"SELECT {K}, CAST(ord AS INT) AS ordinal, CAST(ord - 23940 AS INT) AS month_index FROM panel")
def month_ordinal(spark, sf_dir):
    """P1 and P2."""
    return panel(spark, sf_dir).select(*KEYS, ordinal("mes").alias("ordinal"),
                                       month_index("mes", 199501).alias("month_index"))


@query("p3_variant_history", PANEL_SQL + f"""
SELECT {K}, edad, numero_productos, CAST(min(mes) OVER u AS INT) AS mes_primera_aparicion, CAST(row_number() OVER w - 1 AS INT) AS n_observaciones_previas
FROM panel {ENTITY_WINDOW}""")
def variant_history(spark, sf_dir):
    df, features = FAM.variant(panel(spark, sf_dir), "history")
    assert "objetivo" not in features and "id_cliente" not in features
    keep = [c for c in features if c in ("edad", "numero_productos", "mes_primera_aparicion",
                                         "n_observaciones_previas")]
    return df.select(*KEYS, *keep)


@query("p4_matrix_d", PANEL_SQL + f"""
SELECT {K}, edad, ingresos, CAST(ord - 23940 AS INT) AS month_index, row_number() OVER w > 1 AS cliente_recurrente,
  CAST(ord - min(ord) OVER u AS INT) AS meses_desde_entrada FROM panel {ENTITY_WINDOW}""")
def matrix_d(spark, sf_dir):
    df, features = FAM.matrix(panel(spark, sf_dir), "D", "index", 199501)
    keep = [c for c in ("edad", "ingresos", "month_index", "cliente_recurrente", "meses_desde_entrada")
            if c in features]
    return df.select(*KEYS, *keep)


@query("p5_column_transforms", PANEL_SQL + f"""
SELECT {K}, round({rank_sql('dias_ultima_interaccion', 'mes')}, 9) AS dias_ultima_interaccion,
  CASE banda_riesgo WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS banda_riesgo_ord FROM panel""")
def column_transforms(spark, sf_dir):
    df = panel(spark, sf_dir).select(*KEYS, "dias_ultima_interaccion", "banda_riesgo")
    return rounded(FAM.transform(FAM.transform(df, "rank_interaccion"), "ordinal_band"))


@query("p6_category_codes", PANEL_SQL + ", " + ", ".join(
    f"c{i} AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INT) AS code FROM (SELECT DISTINCT {c} FROM panel WHERE mes <= 199512))"
    for i, c in enumerate(CATEGORICAL_COLUMNS)) + f" SELECT {K}, " + ", ".join(
    f"coalesce(c{i}.code, CAST((SELECT count(*) FROM c{i}) AS INT)) AS {c}_code" for i, c in enumerate(CATEGORICAL_COLUMNS)) + " FROM panel "
    + " ".join(f"LEFT JOIN c{i} ON {c} = c{i}.v" for i, c in enumerate(CATEGORICAL_COLUMNS)))
def category_codes(spark, sf_dir):
    """All categories of the panel by the vocabulary of its first year."""
    df = panel(spark, sf_dir)
    vocabulary = E.category_vocabulary(df.where(F.col("mes") <= 199512), CATEGORICAL_COLUMNS)
    return E.encode_categories(df, vocabulary, CATEGORICAL_COLUMNS, KEYS)


@query("p7_null_bool_normalisation", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END, '__UNKNOWN__') AS priority,
  CAST(o_orderstatus = 'F' AS INT) AS is_fulfilled FROM orders""")
def null_bool_normalisation(spark, sf_dir):
    from cohortica.sources.readers import read_table
    orders = read_table(spark, sf_dir, "orders").withColumn(
        "priority", F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")))
    return orders.select("o_orderkey", X.known_category("priority").alias("priority"),
                         (F.col("o_orderstatus") == "F").cast("int").alias("is_fulfilled"))


@query("p8_pair_keys", PANEL_SQL + f"""
SELECT {K}, ocupacion, region, banda_riesgo, ocupacion || '|' || region AS ocupacion__region,
  ocupacion || '|' || banda_riesgo AS ocupacion__banda_riesgo, region || '|' || banda_riesgo AS region__banda_riesgo FROM panel""")
def pair_keys(spark, sf_dir):
    keys = X.pair_keys(["ocupacion", "region", "banda_riesgo"])
    return panel(spark, sf_dir).select(*KEYS, *[e.alias(n) for n, e in keys.items()])


@query("p9_behavioural_ratios", PANEL_SQL + f"""
SELECT {K}, round(saldo_promedio / ingresos, 9) AS saldo_ingresos,
  round(ingresos * (1.0::DOUBLE - ratio_deuda_ingresos), 6) AS ingreso_neto,
  round(antiguedad_cuenta_meses / greatest(12.0::DOUBLE * (edad - 18.0::DOUBLE), 1.0::DOUBLE), 9) AS antiguedad_share_vida_adulta,
  round(numero_productos / ((antiguedad_cuenta_meses + 1.0::DOUBLE) / 12.0::DOUBLE), 9) AS productos_por_anio_antiguedad,
  round(visitas_web_ultimos_90_dias / greatest(numero_productos, 1), 9) AS visitas_por_producto,
  round(dias_ultima_transaccion / (antiguedad_cuenta_meses + 1.0::DOUBLE), 9) AS recencia_ratio,
  round({rank_sql('abs(dias_ultima_interaccion - dias_ultima_transaccion)', 'mes')}, 9) AS gap_interaccion_rank FROM panel""")
def ratios(spark, sf_dir):
    out = FAM.families()["F2_ratios"][0](panel(spark, sf_dir))
    return rounded(out.withColumn("ingreso_neto", F.round("ingreso_neto", 6)), skip=("ingreso_neto",))


CALENDAR_SQL = """
hol(day) AS (SELECT CAST(d AS DATE) FROM (VALUES """ + ", ".join(f"('{d}')" for d in CAL.HOLIDAYS_2026) + """) t(d)),
dd AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2026-01-01', DATE '2027-01-31', INTERVAL 1 DAY) t(d)),
d1 AS (SELECT dd.day, CAST(isodow(dd.day) - 1 AS INT) AS wd, CASE WHEN hol.day IS NULL THEN 0 ELSE 1 END AS h FROM dd LEFT JOIN hol ON dd.day = hol.day),
d2 AS (SELECT *, CASE WHEN wd < 5 AND h = 0 THEN 1 ELSE 0 END AS b FROM d1),
d3 AS (SELECT *, year(day) * 100 + month(day) AS p,
  date_diff('day', day, min(CASE WHEN b = 1 THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS to_b,
  sum(b) OVER (PARTITION BY year(day), month(day)) AS mb, sum(h) OVER (PARTITION BY year(day), month(day)) AS mh FROM d2)"""


@query("p10_calendar_features", PANEL_SQL + "," + CALENDAR_SQL + f"""
SELECT id_cliente, 202600 + mes % 100 AS mes, panel.mes AS source_mes, wd AS pay_weekday, CASE WHEN wd >= 5 THEN 1 ELSE 0 END AS pay_is_weekend,
  h AS pay_is_holiday, CAST(to_b AS INT) AS pay_days_to_business_day, CAST(mb AS INT) AS month_business_days, CAST(mh AS INT) AS month_holidays,
  CAST(day(last_day(d3.day)) AS INT) AS month_days, CASE WHEN mes % 100 IN (7, 12) THEN 1 ELSE 0 END AS gratificacion_month,
  CASE WHEN mes % 100 IN (5, 11) THEN 1 ELSE 0 END AS cts_month
FROM panel JOIN d3 ON p = 202600 + mes % 100 AND day(d3.day) = dia_preferido_pago""")
def calendar_features(spark, sf_dir):
    """P10 and P11; the order month is placed in the year of the holiday table."""
    df = panel(spark, sf_dir).select(
        "id_cliente", F.col("mes").alias("source_mes"),
        (F.lit(202600) + F.pmod("mes", F.lit(100))).alias("mes"), "dia_preferido_pago")
    return CAL.add_calendar(df, "mes", "dia_preferido_pago", flags=True).drop("dia_preferido_pago")


@query("p12_holiday_coverage", PANEL_SQL + "SELECT count(*) FILTER (mes // 100 <> 1999) AS uncovered_rows FROM panel")
def holiday_coverage(spark, sf_dir):
    return CAL.holiday_coverage(panel(spark, sf_dir), "mes", 1999)


@query("p13_time_decay", PANEL_SQL + f"""
SELECT {K}, round(pow(0.5::DOUBLE, ((SELECT max(ord) FROM panel) - ord) / 6.0::DOUBLE), 12) AS weight FROM panel""")
def time_decay_weight(spark, sf_dir):
    df = panel(spark, sf_dir).select(*KEYS)
    newest = df.agg(F.max("mes").alias("_newest"))  # one row
    return df.crossJoin(F.broadcast(newest)).select(
        *KEYS, F.round(time_decay("mes", "_newest", 6.0), 12).alias("weight"))


@query("p14_recent_window", PANEL_SQL + f"SELECT {K} FROM panel WHERE ord <= 23992 AND ord > 23986")
def recent_window(spark, sf_dir):
    return panel(spark, sf_dir).select(*KEYS).where(in_recent_window("mes", 199905, 6))


@query("p15_rule_flags", PANEL_SQL + f""",
pk AS (SELECT *, row_number() OVER (PARTITION BY id_cliente ORDER BY mes) AS kk, banda_riesgo = 'low' AS lo, banda_riesgo = 'high' AS hi,
  banda_riesgo = 'medium' AS me, activo_movil AND tiene_tarjeta_credito AS mc, dias_ultima_transaccion AS dt, numero_productos AS np FROM panel)
SELECT {K}, lo::INT::DOUBLE AS "L", hi::INT::DOUBLE AS "H", (lo AND np >= 3)::INT::DOUBLE AS "L_p3", (lo AND mc AND np >= 2)::INT::DOUBLE AS "L_mc_p2",
  round(lo::INT * (dt / 365.0::DOUBLE), 9) AS "L_dtx", (hi AND dt < 100)::INT::DOUBLE AS "H_dtx100", (hi AND dt < 180)::INT::DOUBLE AS "H_dtx180",
  (hi AND dt >= 180 AND canal_adquisicion = 'branch')::INT::DOUBLE AS "H_old_branch", round(me::INT * (dt / 365.0::DOUBLE), 9) AS "M_dtx",
  round(ln(kk), 9) AS k, ((lo OR me) AND ratio_deuda_ingresos >= 0.6)::INT::DOUBLE AS "LM_debt60", (saldo_promedio <= 300)::INT::DOUBLE AS saldo_floor FROM pk""")
def rule_flags(spark, sf_dir):
    df = panel(spark, sf_dir).withColumn("kk", H.months_in_panel())
    return rounded(df.select(*KEYS, *[e.alias(n) for n, e in X.rule_flags("kk").items()]))


@query("p16_submission_flags", PANEL_SQL + f""",
pk AS (SELECT *, banda_riesgo = 'low' AS lo, banda_riesgo = 'high' AS hi, activo_movil AND tiene_tarjeta_credito AS mc,
  dias_ultima_transaccion > 180 AS st, canal_adquisicion = 'branch' AS br FROM panel)
SELECT {K}, mc::INT AS movil_y_tarjeta, (lo AND numero_productos >= 3)::INT AS riesgo_low_productos_3_o_mas,
  (lo AND numero_productos >= 2 AND mc)::INT AS riesgo_low_movil_tarjeta_2_o_mas, st::INT AS transaccion_mas_180,
  (hi AND st)::INT AS riesgo_high_transaccion_mas_180, (hi AND br)::INT AS riesgo_high_canal_branch,
  (hi AND br AND st)::INT AS riesgo_high_branch_transaccion_mas_180, (lo AND ratio_deuda_ingresos >= 0.6)::INT AS riesgo_low_deuda_06,
  (hi AND dias_ultima_transaccion < 100)::INT AS riesgo_high_menos_100 FROM pk""")
def submission_flags(spark, sf_dir):
    return panel(spark, sf_dir).select(*KEYS, *[e.alias(n) for n, e in X.submission_flags().items()])


@query("p17_copy_flag", PANEL_SQL + f"SELECT {K}, dias_ultima_interaccion = dias_ultima_transaccion AS is_copy FROM panel")
def copy_flag(spark, sf_dir):
    return panel(spark, sf_dir).select(
        *KEYS, X.copy_flag("dias_ultima_interaccion", "dias_ultima_transaccion").alias("is_copy"))


def edges_sql(column: str, bins: int, where: str) -> str:
    return (f"(SELECT list_sort(list_distinct([" + ", ".join(
        f"quantile_cont(CAST({column} AS DOUBLE), {i / bins})" for i in range(bins + 1))
        + f"])) FROM panel WHERE {where})")


def bin_sql(column: str, edges: str) -> str:
    inner = f"SELECT unnest({edges}[2:len({edges}) - 1]) AS e"
    return f"CAST((SELECT count(*) FROM ({inner}) WHERE e <= {column}) AS INT)"


@query("p18_quantile_bins", PANEL_SQL + f""",
ed AS (SELECT {edges_sql('saldo_promedio', 6, f'mes <= {TRAIN_THROUGH}')} AS e1, {edges_sql('numero_productos', 6, f'mes <= {TRAIN_THROUGH}')} AS e2)
SELECT {K}, {bin_sql('saldo_promedio', 'e1')} AS saldo_promedio_bin, {bin_sql('numero_productos', 'e2')} AS numero_productos_bin FROM panel, ed""")
def quantile_bins(spark, sf_dir):
    df = panel(spark, sf_dir)
    return E.quantile_bins(df.where(F.col("mes") <= TRAIN_THROUGH), df,
                           ["saldo_promedio", "numero_productos"], 6, KEYS)


@query("p19_band_bin_keys", PANEL_SQL + f""",
ed AS (SELECT {edges_sql('edad', 6, f'mes <= {TRAIN_THROUGH}')} AS e1)
SELECT {K}, banda_riesgo || '_edad_' || CAST({bin_sql('edad', 'e1')} AS VARCHAR) AS edad_bin FROM panel, ed""")
def band_bin_keys(spark, sf_dir):
    df = panel(spark, sf_dir)
    bins = E.quantile_bins(df.where(F.col("mes") <= TRAIN_THROUGH), df, ["edad"], 6, KEYS)
    return df.select(*KEYS, "banda_riesgo").join(bins, KEYS).select(
        *KEYS, *E.cross_keys("banda_riesgo", ["edad_bin"]))


@query("p20_design_stats", PANEL_SQL + f", t AS (SELECT * FROM panel WHERE mes <= {TRAIN_THROUGH}) SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM t" for c in NUMERIC_COLUMNS]
    + [f"""SELECT f, round(n / tot, 6), round(sqrt((n / tot) * (1 - n / tot)), 6) FROM (
  SELECT '{c}_' || {c} AS f, count(*) AS n, (SELECT count(*)::DOUBLE FROM t) AS tot FROM t WHERE {c} > (SELECT min({c}) FROM t) GROUP BY 1)"""
       for c in CATEGORICAL_COLUMNS]) + ") WHERE std > 0")
def design_stats(spark, sf_dir):
    train = panel(spark, sf_dir).where(F.col("mes") <= TRAIN_THROUGH)
    return rounded(E.design_stats(train, NUMERIC_COLUMNS, CATEGORICAL_COLUMNS), 6)


@query("p21_cell_key", PANEL_SQL + f"""
SELECT {K}, banda_riesgo || '|' || CAST(least(numero_productos, 3) AS VARCHAR) || '|' || CAST(activo_movil AND tiene_tarjeta_credito AS VARCHAR) || '|' ||
  CASE WHEN dias_ultima_transaccion > 0 AND dias_ultima_transaccion <= 100 THEN '1' WHEN dias_ultima_transaccion > 100 AND dias_ultima_transaccion <= 180 THEN '2'
       WHEN dias_ultima_transaccion > 180 AND dias_ultima_transaccion <= 400 THEN '3' ELSE 'none' END AS cell FROM panel""")
def cell_key(spark, sf_dir):
    return panel(spark, sf_dir).select(*KEYS, X.cell_key().alias("cell"))


@query("p22_fixed_width_bins", PANEL_SQL + f"""
SELECT {K}, CAST((dias_ultima_transaccion // 30) * 30 AS INT) AS dtx_bin, least(numero_productos, 6) AS products_capped FROM panel""")
def fixed_width_bins(spark, sf_dir):
    return panel(spark, sf_dir).select(
        *KEYS, X.fixed_width_bin("dias_ultima_transaccion", 30).alias("dtx_bin"),
        X.capped("numero_productos", 6).alias("products_capped"))


@query("p23_links", PANEL_SQL + f"""
SELECT {K}, round(1 / (1 + exp(-((edad - 40) / 10.0::DOUBLE))), 9) AS logistic,
  round(1 - exp(-exp(greatest(least((edad - 40) / 10.0::DOUBLE, 40), -40))), 9) AS hazard FROM panel""")
def links(spark, sf_dir):
    z = (F.col("edad") - 40) / F.lit(10.0)
    return rounded(panel(spark, sf_dir).select(
        *KEYS, X.sigmoid(z).alias("logistic"), X.hazard_probability(z).alias("hazard")))


@query("p24_model_ready", PANEL_SQL + f"""
SELECT {K}, CAST(CAST(ingresos AS FLOAT) AS DOUBLE) AS ingresos, CAST(tiene_seguro AS INT) AS tiene_seguro FROM panel""")
def model_ready(spark, sf_dir):
    df = panel(spark, sf_dir).select(*KEYS, *X.model_ready(["ingresos"], ["tiene_seguro"]))
    return df.withColumn("ingresos", F.col("ingresos").cast("double"))


# ------------------------------------------------------------------ windows
@query("w1_history_features", PANEL_SQL + f"""
SELECT {K}, CAST(min(mes) OVER u AS INT) AS mes_primera_aparicion, CAST(ord - min(ord) OVER u AS INT) AS meses_desde_entrada,
  CAST(ord - min(ord) OVER u + 1 AS INT) AS meses_en_riesgo, CAST(row_number() OVER w - 1 AS INT) AS n_observaciones_previas,
  row_number() OVER w > 1 AS cliente_recurrente FROM panel {ENTITY_WINDOW}""")
def history_features(spark, sf_dir):
    return H.add_history(panel(spark, sf_dir).select(*KEYS))


@query("w2_months_in_panel", PANEL_SQL + f"SELECT {K}, CAST(row_number() OVER w AS INT) AS k FROM panel {ENTITY_WINDOW}")
def months_in_panel(spark, sf_dir):
    return panel(spark, sf_dir).select(*KEYS, H.months_in_panel().alias("k"))


@query("w3_lags", PANEL_SQL + f"""
SELECT {K}, lag(dias_ultima_interaccion, 1) OVER w AS lag1, lag(dias_ultima_interaccion, 2) OVER w AS lag2,
  dias_ultima_interaccion - lag(dias_ultima_interaccion, 1) OVER w AS delta FROM panel {ENTITY_WINDOW}""")
def lags(spark, sf_dir):
    """W3 and W4."""
    return panel(spark, sf_dir).select(
        *KEYS, *[e.alias(n) for n, e in H.lags("dias_ultima_interaccion").items()])


@query("w6_trajectory", PANEL_SQL + f""",
b AS (SELECT *, CAST(dias_ultima_interaccion AS DOUBLE) AS v, CAST(ord - min(ord) OVER u AS DOUBLE) AS t,
  CAST(lag(dias_ultima_interaccion) OVER w AS DOUBLE) AS l1, CAST(lag(dias_ultima_interaccion, 2) OVER w AS DOUBLE) AS l2 FROM panel {ENTITY_WINDOW})
SELECT {K}, l1 AS interaction_lag1, l2 AS interaction_lag2, v - l1 AS interaction_delta,
  round((count(*) OVER u * sum(t * v) OVER u - sum(t) OVER u * sum(v) OVER u) / nullif(count(*) OVER u * sum(t * t) OVER u - sum(t) OVER u * sum(t) OVER u, 0), 9) AS interaction_slope,
  min(v) OVER u AS interaction_min, max(v) OVER u AS interaction_max, round(avg(v) OVER u, 9) AS interaction_mean,
  CASE WHEN v < l1 THEN 1 ELSE 0 END AS interaction_reset, CAST(sum(CASE WHEN v < l1 THEN 1 ELSE 0 END) OVER u AS INT) AS interaction_resets
FROM b {ENTITY_WINDOW}""")
def trajectory(spark, sf_dir):
    """W3 to W7."""
    df = panel(spark, sf_dir).select(*KEYS, "dias_ultima_interaccion")
    return rounded(H.trajectory(df, "dias_ultima_interaccion").drop("dias_ultima_interaccion"))


@query("w8_equality_with_previous", PANEL_SQL + """,
b AS (SELECT dias_ultima_interaccion = lag(dias_ultima_interaccion) OVER (PARTITION BY id_cliente ORDER BY mes) AS same FROM panel)
SELECT count(*) AS n_rows, round(avg(same::INT), 9) AS same_share FROM b WHERE same IS NOT NULL""")
def equality_with_previous(spark, sf_dir):
    return rounded(H.equality_with_previous(panel(spark, sf_dir), "dias_ultima_interaccion"))


@query("w8_flag_transitions", PANEL_SQL + """,
f AS (SELECT id_cliente, mes, dias_ultima_interaccion = dias_ultima_transaccion AS cur FROM panel),
b AS (SELECT lag(cur) OVER (PARTITION BY id_cliente ORDER BY mes) AS previous, cur AS "current" FROM f)
SELECT previous, "current", count(*) AS n_rows FROM b WHERE previous IS NOT NULL GROUP BY 1, 2""")
def flag_transitions(spark, sf_dir):
    return H.flag_transitions(panel(spark, sf_dir),
                              X.copy_flag("dias_ultima_interaccion", "dias_ultima_transaccion"))


@query("w9_rank_all_columns", PANEL_SQL + f"SELECT {K}, " + ", ".join(
    f"round({rank_sql(c, 'mes')}, 9) AS rk_{c}" for c in NUMERIC_COLUMNS) + " FROM panel")
def rank_all_columns(spark, sf_dir):
    return pct_ranks(panel(spark, sf_dir), KEYS, ["mes"], NUMERIC_COLUMNS, digits=9)


COHORT_SQL = PANEL_SQL + ", co AS (SELECT *, min(mes) OVER (PARTITION BY id_cliente) AS cohort FROM panel)"


@query("w10_cohort_ranks", COHORT_SQL + f"SELECT {K}, " + ", ".join(
    f"round({rank_sql(c, 'cohort, mes')}, 9) AS cohort_rk_{c}" for c in NUMERIC_COLUMNS) + " FROM co")
def cohort_ranks(spark, sf_dir):
    return rounded(H.cohort_ranks(panel(spark, sf_dir), NUMERIC_COLUMNS))


@query("w11_cohort_survival", COHORT_SQL + f"""
SELECT {K}, CAST(sum(CASE WHEN mes = cohort THEN 1 ELSE 0 END) OVER (PARTITION BY cohort) AS BIGINT) AS cohort_size_initial,
  round(count(*) OVER (PARTITION BY cohort, mes) / CAST(sum(CASE WHEN mes = cohort THEN 1 ELSE 0 END) OVER (PARTITION BY cohort) AS DOUBLE), 9) AS cohort_survival FROM co""")
def cohort_survival(spark, sf_dir):
    out = H.cohort_survival(panel(spark, sf_dir).select(*KEYS))
    return rounded(out.select(*KEYS, "cohort_size_initial", "cohort_survival"))


@query("w12_risk_intervals", PANEL_SQL + f"""
SELECT {K}, objetivo, CAST(ord - min(ord) OVER u AS INT) AS start, CAST(ord - min(ord) OVER u + 1 AS INT) AS stop,
  (lead(mes) OVER w IS NULL) AND objetivo = 0 AS censored_last_observation FROM panel {ENTITY_WINDOW}""")
def risk_intervals(spark, sf_dir):
    """W12 and W13."""
    return H.risk_intervals(panel(spark, sf_dir).select(*KEYS, "objetivo"))


# The five categories and their ten pairs.
TE_KEYS = {c: c for c in CATEGORICAL_COLUMNS} | {
    f"{a}__{b}": f"{a} || '|' || {b}" for a, b in combinations(CATEGORICAL_COLUMNS, 2)}


def te_sql(name: str, key: str, source: str = "panel") -> str:
    return f"""
{name}_a AS (SELECT {key} AS g, mes, CAST(sum(objetivo) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY 1, 2),
{name}_b AS (SELECT g, mes, coalesce(sum(y) OVER w, 0) AS yb, coalesce(sum(n) OVER w, 0) AS nb FROM {name}_a
  WINDOW w AS (PARTITION BY g ORDER BY mes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("w14_causal_target_encoding", PANEL_SQL + f""",
pr AS (SELECT mes, sum(y) OVER w / sum(n) OVER w AS prior FROM (SELECT mes, CAST(sum(objetivo) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS n FROM panel GROUP BY 1)
  WINDOW w AS (ORDER BY mes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{", ".join(te_sql(f"t{i}", key) for i, key in enumerate(TE_KEYS.values()))}
SELECT id_cliente, panel.mes, {", ".join(f"round((t{i}_b.yb + 50 * prior) / (t{i}_b.nb + 50), 9) AS te_{name}" for i, name in enumerate(TE_KEYS))}
FROM panel LEFT JOIN pr ON panel.mes = pr.mes {" ".join(f"LEFT JOIN t{i}_b ON t{i}_b.g = {key} AND t{i}_b.mes = panel.mes" for i, key in enumerate(TE_KEYS.values()))}""")
def target_encoding(spark, sf_dir):
    """Every category and every pair."""
    return rounded(E.causal_target_encoding(panel(spark, sf_dir), X.pair_keys(CATEGORICAL_COLUMNS)))


@query("w15_min_rank_position", SCORES_SQL + f"""
SELECT {K}, CAST(rank() OVER (PARTITION BY mes ORDER BY m3) - 1 AS BIGINT) AS first_position FROM scores""")
def min_rank_position(spark, sf_dir):
    df = scores(spark, sf_dir)
    first = value_ranks(df, ["mes"], "m3").select("mes", "m3", F.col("n_before").alias("first_position"))
    return df.join(first, ["mes", "m3"]).select(*KEYS, "first_position")


@query("w17_period_gap", PANEL_SQL + f"""
SELECT {K}, mes - lag(mes) OVER w AS gap_raw, CAST(ord - lag(ord) OVER w AS INT) AS gap_months FROM panel {ENTITY_WINDOW}""")
def period_gap(spark, sf_dir):
    return panel(spark, sf_dir).select(*KEYS, H.period_gap().alias("gap_raw"),
                                       H.period_gap(calendar=True).alias("gap_months"))


@query("w18_oof_rank_columns", SCORES_SQL + f"SELECT {K}, " + ", ".join(
    f"round({rank_sql(m, 'mes')}, 9) AS rank_{m}" for m in ("m1", "m2", "m3")) + " FROM valid")
def oof_rank_columns(spark, sf_dir):
    from cohortica.plans.panel import valid_scores
    return pct_ranks(valid_scores(spark, sf_dir), KEYS, ["mes"], ["m1", "m2", "m3"], "rank_", 9)


@query("m19_family_union", PANEL_SQL + f"""
SELECT {K}, edad, round(saldo_promedio / ingresos, 9) AS saldo_ingresos, round({rank_sql('edad', 'mes')}, 9) AS rk_edad FROM panel""")
def family_union(spark, sf_dir):
    """Two families on one base, first column wins."""
    df = panel(spark, sf_dir)
    out = FAM.apply_families(df, df.select(*KEYS, "edad"), ["F2_ratios", "F3_rank_all"])
    return rounded(out.select(*KEYS, "edad", "saldo_ingresos", "rk_edad"))
