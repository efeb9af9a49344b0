"""Joins, exploratory tables, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cohortica.functions import features as X
from cohortica.functions.ordered import lookup_positions, quantiles_wide, value_ranks
from cohortica.operators import history as H
from cohortica.operators import joins as J
from cohortica.operators import profile as P
from cohortica.operators import splits as S
from cohortica.operators.contracts import row_set_difference
from cohortica.plans.panel import (CHANNELS, CUTS, PANEL_SQL, RISK_BANDS, SCORE_MONTH, SCORES_SQL,
                                   TRAIN_THROUGH, long_scores, panel, scores, valid_scores)
from cohortica.plans.q_contracts import TRAIN_SCORE_SQL, raw_months, train_score
from cohortica.plans.q_features import ENTITY_WINDOW, KEYS, K, edges_sql, rounded
from cohortica.plans.q_metrics import rank_sql
from cohortica.plans.registry import query
from cohortica.spec import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS

NUMS = NUMERIC_COLUMNS


# ------------------------------------------------------------------ joins
@query("j1_event_period", PANEL_SQL + f"""
SELECT {K}, ev AS event_period FROM panel LEFT JOIN (SELECT id_cliente AS i, min(mes) AS ev FROM panel WHERE objetivo = 1 GROUP BY 1) ON i = id_cliente""")
def event_period(spark, sf_dir):
    return J.with_event_period(panel(spark, sf_dir).select(*KEYS, "objetivo")).select(*KEYS, "event_period")


@query("j2_membership", TRAIN_SCORE_SQL + "SELECT id_cliente, id_cliente IN (SELECT id_cliente FROM train) AS survivor FROM score")
def membership(spark, sf_dir):
    train, score = train_score(spark, sf_dir)
    return J.with_membership(score.select("id_cliente"), train, "id_cliente", "survivor")


@query("j3_strict_join", SCORES_SQL + f"SELECT {K}, objetivo, m1, m2, m3 FROM valid")
def strict_join(spark, sf_dir):
    """Three prediction tables on the key, checked first."""
    df = valid_scores(spark, sf_dir)
    tables = [df.select(*KEYS, "objetivo", m) for m in ("m1", "m2", "m3")]
    return J.strict_join(tables)


@query("j4_validated_join", SCORES_SQL + """
SELECT count(*) AS n_rows, count(*) FILTER (id_cliente % 17 = 0) AS unmatched_left, CAST(0 AS BIGINT) AS unmatched_right,
  CAST(0 AS BIGINT) AS duplicates_left, count(*) FILTER (id_cliente % 17 <> 0 AND id_cliente % 6 = 1) AS duplicates_right,
  count(*) FILTER (id_cliente % 17 <> 0 AND id_cliente % 19 = 0) AS label_differences FROM valid""")
def validated_join(spark, sf_dir):
    df = valid_scores(spark, sf_dir).select(*KEYS, "objetivo")
    other = df.where(F.col("id_cliente") % 17 != 0).withColumn("objetivo", F.when(
        F.col("id_cliente") % 19 == 0, 1 - F.col("objetivo")).otherwise(F.col("objetivo")))
    return J.strict_join_report(df, other.unionByName(other.where(F.col("id_cliente") % 6 == 1)))


@query("j5_reorder_by_id", SCORES_SQL + f"""
SELECT id_cliente, row_number() OVER (ORDER BY saldo_promedio, id_cliente) - 1 AS row_ord, round(m1, 9) AS m1, round(m3, 9) AS m3
FROM scores WHERE mes = {SCORE_MONTH}""")
def reorder_by_id(spark, sf_dir):
    """Two member tables in the order of a reference table."""
    from cohortica.sources.readers import source_row_index
    df = scores(spark, sf_dir).where(F.col("mes") == SCORE_MONTH)
    order = source_row_index(df.select("id_cliente", "m2"), ["m2", "id_cliente"])
    return rounded(J.align_members([df.select("id_cliente", "m1"), df.select("id_cliente", "m3")],
                                   order, "id_cliente"))


@query("j8_recurrent_lookup", PANEL_SQL + f"""
SELECT {K}, recurrent FROM (SELECT *, row_number() OVER w > 1 AS recurrent FROM panel {ENTITY_WINDOW}) WHERE mes IN (199901, 199902, 199903)""")
def recurrent_lookup(spark, sf_dir):
    df = panel(spark, sf_dir).select(*KEYS)
    flags = H.add_history(df).select(*KEYS, F.col("cliente_recurrente").alias("recurrent"))
    return df.where(F.col("mes").isin([199901, 199902, 199903])).join(flags, KEYS, "left")


@query("j9_period_pairs", PANEL_SQL + """
SELECT count(*) AS n_entities, round(avg((a.v = b.v)::INT), 9) AS same_share, round(corr(a.v, b.v), 9) AS correlation FROM
  (SELECT id_cliente, dias_ultima_interaccion AS v FROM panel WHERE mes = 199811) a JOIN (SELECT id_cliente, dias_ultima_interaccion AS v FROM panel WHERE mes = 199812) b USING (id_cliente)""")
def period_pairs(spark, sf_dir):
    return rounded(J.period_pairs(panel(spark, sf_dir), "dias_ultima_interaccion", 199811, 199812))


@query("j12_risk_sets", PANEL_SQL + f""",
r AS (SELECT id_cliente, objetivo, ord - min(ord) OVER u AS start, ord - min(ord) OVER u + 1 AS stop FROM panel {ENTITY_WINDOW}),
t AS (SELECT DISTINCT stop AS event_time FROM r WHERE objetivo = 1)
SELECT CAST(event_time AS INT) AS event_time, count(*) AS at_risk, CAST(sum(CASE WHEN stop = event_time THEN objetivo ELSE 0 END) AS BIGINT) AS events
FROM r JOIN t ON start < event_time AND stop >= event_time GROUP BY 1""")
def risk_sets(spark, sf_dir):
    intervals = H.risk_intervals(panel(spark, sf_dir).select(*KEYS, "objetivo"))
    times = intervals.where(F.col("objetivo") == 1).select(F.col("stop").alias("event_time"))
    return J.risk_set(intervals, times).groupBy("event_time").agg(
        F.count(F.lit(1)).alias("at_risk"),
        F.sum(F.when(F.col("stop") == F.col("event_time"), F.col("objetivo")).otherwise(0)).alias("events"))


@query("j15_row_subset", PANEL_SQL + f"""
SELECT {K}, edad FROM panel WHERE id_cliente IN (SELECT id_cliente FROM panel WHERE mes = 199901)""")
def row_subset(spark, sf_dir):
    df = panel(spark, sf_dir)
    return df.select(*KEYS, "edad").join(
        df.where(F.col("mes") == 199901).select("id_cliente"), "id_cliente", "left_semi")


# ------------------------------------------------------------------ tables
@query("a1_period_profile", PANEL_SQL + "SELECT mes, count(*) AS n_rows, CAST(sum(objetivo) AS BIGINT) AS events, round(avg(objetivo), 9) AS rate FROM panel GROUP BY mes")
def period_profile(spark, sf_dir):
    return rounded(P.rate_by(panel(spark, sf_dir), ["mes"], "objetivo"))


@query("a2_distinct_entities", TRAIN_SCORE_SQL + """
SELECT 'train' AS "table", count(DISTINCT id_cliente) AS n_entities FROM train UNION ALL SELECT 'score', count(DISTINCT id_cliente) FROM score""")
def distinct_entities(spark, sf_dir):
    train, score = train_score(spark, sf_dir)
    return P.distinct_entities({"train": train, "score": score}, "id_cliente")


@query("a3_periods_per_entity", PANEL_SQL + """
SELECT n_periods, count(*) AS n_entities FROM (SELECT id_cliente, count(DISTINCT mes) AS n_periods FROM panel GROUP BY 1) GROUP BY 1""")
def periods_per_entity(spark, sf_dir):
    return P.periods_per_entity(panel(spark, sf_dir))


@query("a4_gap_histogram", PANEL_SQL + """
SELECT gap, count(*) AS n_rows FROM (SELECT mes - lag(mes) OVER (PARTITION BY id_cliente ORDER BY mes) AS gap FROM panel)
WHERE gap IS NOT NULL GROUP BY 1 ORDER BY n_rows DESC, gap LIMIT 5""")
def gap_histogram(spark, sf_dir):
    return P.gap_histogram(panel(spark, sf_dir))


@query("a5_entry_histogram", PANEL_SQL + "SELECT entry, count(*) AS n_entities FROM (SELECT min(mes) AS entry FROM panel GROUP BY id_cliente) GROUP BY 1")
def entry_histogram(spark, sf_dir):
    return P.entry_histogram(panel(spark, sf_dir))


@query("a6_variability", PANEL_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(v::INT), 9) AS varying_share FROM (SELECT count(DISTINCT {c}) > 1 AS v FROM panel GROUP BY id_cliente)"
    for c in ("edad", "numero_productos", "dias_ultima_interaccion", "banda_riesgo")))
def variability(spark, sf_dir):
    return rounded(P.variability(panel(spark, sf_dir), [
        "edad", "numero_productos", "dias_ultima_interaccion", "banda_riesgo"]))


@query("a7_category_rates", PANEL_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n_rows, CAST(sum(objetivo) AS BIGINT) AS events, round(avg(objetivo), 9) AS rate FROM panel GROUP BY {c}"
    for c in CATEGORICAL_COLUMNS))
def category_rates(spark, sf_dir):
    return rounded(P.category_rates(panel(spark, sf_dir), CATEGORICAL_COLUMNS, "objetivo"))


def describe_sql(column: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    return f"""SELECT {head}'{column}' AS "column", count({column}) AS n_rows, round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS std,
  CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max, round(quantile_cont(CAST({column} AS DOUBLE), 0.01), 4) AS p1,
  round(quantile_cont(CAST({column} AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST({column} AS DOUBLE), 0.99), 4) AS p99 FROM panel {'GROUP BY ' + by if by else ''}"""


@query("a8_describe", PANEL_SQL + " UNION ALL ".join(describe_sql(c) for c in NUMS))
def describe(spark, sf_dir):
    return rounded(P.describe(panel(spark, sf_dir), NUMS), 4)


@query("a8_describe_by_band", PANEL_SQL + " UNION ALL ".join(describe_sql(c, "banda_riesgo") for c in NUMS))
def describe_by_band(spark, sf_dir):
    return rounded(P.describe(panel(spark, sf_dir), NUMS, ["banda_riesgo"]), 4)


def modal_sql(c: str) -> str:
    return f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS value, count(*) AS n_rows, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INT) AS position,
  (SELECT count(DISTINCT {c}) FROM panel) AS n_distinct FROM panel GROUP BY {c}) WHERE position <= 3"""


@query("a9_modal_values", PANEL_SQL + " UNION ALL ".join(modal_sql(c) for c in NUMS))
def modal_values(spark, sf_dir):
    return P.modal_values(panel(spark, sf_dir), NUMS)


@query("a10_decile_rates", PANEL_SQL + f""",
ed AS (SELECT {edges_sql('ingresos', 10, 'true')} AS e),
b AS (SELECT objetivo, CAST((SELECT count(*) FROM (SELECT unnest(e[2:len(e) - 1]) AS x) WHERE x < ingresos) AS INT) AS bin FROM panel, ed)
SELECT 'ingresos' AS "column", bin, count(*) AS n_rows, CAST(sum(objetivo) AS BIGINT) AS events, round(avg(objetivo), 9) AS rate FROM b GROUP BY bin""")
def decile_rates(spark, sf_dir):
    return rounded(P.decile_rates(panel(spark, sf_dir), ["ingresos"], "objetivo"))


@query("a11_crosstab", PANEL_SQL + """
SELECT canal_adquisicion AS a, dispositivo_principal AS b, count(*) AS n_rows,
  round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY canal_adquisicion) AS DOUBLE), 9) AS share FROM panel GROUP BY 1, 2""")
def crosstab(spark, sf_dir):
    return rounded(P.crosstab(panel(spark, sf_dir), "canal_adquisicion", "dispositivo_principal"))


@query("a12_pivot_rates", PANEL_SQL + "SELECT CAST((dias_ultima_transaccion // 30) * 30 AS INT) AS dtx_bin, " + ", ".join(
    f"round(avg(objetivo) FILTER (banda_riesgo = '{b}'), 9) AS {b}_rate, count(*) FILTER (banda_riesgo = '{b}') AS {b}_n" for b in RISK_BANDS)
    + " FROM panel GROUP BY 1")
def pivot_rates(spark, sf_dir):
    out = P.pivot_rates(panel(spark, sf_dir), [X.fixed_width_bin("dias_ultima_transaccion", 30).alias("dtx_bin")],
                        "banda_riesgo", RISK_BANDS, "objetivo")
    return rounded(out).fillna(0, subset=[f"{b}_n" for b in RISK_BANDS])


@query("a13_group_mean_median", PANEL_SQL + """
SELECT ocupacion, round(avg(edad), 6) AS mean_edad, round(avg(saldo_promedio), 6) AS mean_saldo_promedio,
  round(quantile_cont(ingresos, 0.5), 6) AS median_ingresos FROM panel GROUP BY 1""")
def group_mean_median(spark, sf_dir):
    df = panel(spark, sf_dir)
    return rounded(P.group_means(df, "ocupacion", ["edad", "saldo_promedio"]).join(
        P.group_median(df, "ocupacion", "ingresos"), "ocupacion"), 6)


@query("a14_entity_collapse", PANEL_SQL + """
SELECT id_cliente, min_by(numero_productos, mes) AS numero_productos, min_by(banda_riesgo, mes) AS banda_riesgo, max(objetivo) AS objetivo,
  min(mes) AS first_period, count(*) AS n_periods FROM panel GROUP BY 1""")
def entity_collapse(spark, sf_dir):
    return P.collapse_entities(panel(spark, sf_dir), ["numero_productos", "banda_riesgo"])


@query("a15_spearman_matrix", PANEL_SQL + ", rk AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in NUMS) + " FROM panel) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS spearman FROM rk"
                         for i, a in enumerate(NUMS) for b in NUMS[i + 1:]))
def spearman_matrix(spark, sf_dir):
    return rounded(P.spearman_matrix(panel(spark, sf_dir), NUMS, KEYS))


def cramers_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(sqrt(chi / (n * (least(r, c) - 1))), 9) AS cramers_v FROM (
  SELECT max(n) AS n, max(r) AS r, max(c) AS c, sum(CASE WHEN r = 2 AND c = 2 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) ELSE pow(o - e, 2) END / e) AS chi FROM (
    SELECT ra.n_a * cb.n_b / CAST(t.n AS DOUBLE) AS e, coalesce(x.o, 0) AS o, t.n, t.r, t.c
    FROM (SELECT {a} AS va, count(*) AS n_a FROM panel GROUP BY 1) ra CROSS JOIN (SELECT {b} AS vb, count(*) AS n_b FROM panel GROUP BY 1) cb
    CROSS JOIN (SELECT count(*) AS n, count(DISTINCT {a}) AS r, count(DISTINCT {b}) AS c FROM panel) t
    LEFT JOIN (SELECT {a} AS va, {b} AS vb, count(*) AS o FROM panel GROUP BY 1, 2) x ON x.va = ra.va AND x.vb = cb.vb))"""


CATS = ["banda_riesgo", "dispositivo_principal", "activo_movil", "tiene_prestamo", "canal_adquisicion"]


@query("a16_cramers_v", PANEL_SQL + " UNION ALL ".join(
    cramers_sql(a, b) for i, a in enumerate(CATS) for b in CATS[i + 1:]))
def cramers_v(spark, sf_dir):
    return rounded(P.cramers_v(panel(spark, sf_dir), CATS))


@query("a29_copy_drift", PANEL_SQL + """
SELECT mes, count(*) AS n_rows, round(avg((dias_ultima_interaccion = dias_ultima_transaccion)::INT), 9) AS copy_share,
  round(avg(objetivo) FILTER (dias_ultima_interaccion = dias_ultima_transaccion), 9) AS rate_copy,
  round(avg(objetivo) FILTER (dias_ultima_interaccion <> dias_ultima_transaccion), 9) AS rate_other,
  round((12 - mes % 100) / 11.0::DOUBLE, 9) AS theoretical_share FROM panel GROUP BY mes""")
def copy_drift(spark, sf_dir):
    return rounded(P.copy_drift(panel(spark, sf_dir), "dias_ultima_interaccion", "dias_ultima_transaccion"))


CELL_SQL = """banda_riesgo || '|' || CAST(least(numero_productos, 3) AS VARCHAR) || '|' || CAST(activo_movil AND tiene_tarjeta_credito AS VARCHAR) || '|' ||
  CASE WHEN dias_ultima_transaccion > 0 AND dias_ultima_transaccion <= 100 THEN '1' WHEN dias_ultima_transaccion > 100 AND dias_ultima_transaccion <= 180 THEN '2'
       WHEN dias_ultima_transaccion > 180 AND dias_ultima_transaccion <= 400 THEN '3' ELSE 'none' END"""


@query("a30_cell_rates", PANEL_SQL + f""",
c AS (SELECT *, {CELL_SQL} AS cell FROM panel), tr AS (SELECT * FROM c WHERE mes <= 199812),
b AS (SELECT banda_riesgo, avg(objetivo) AS br FROM tr GROUP BY 1), p AS (SELECT cell, banda_riesgo, sum(objetivo) AS y, count(*) AS n FROM tr GROUP BY 1, 2)
SELECT {K}, round(coalesce((y + 200.0::DOUBLE * br) / (n + 200.0::DOUBLE), br), 9) AS cell_rate FROM c LEFT JOIN p USING (cell, banda_riesgo) JOIN b USING (banda_riesgo)
WHERE mes = 199901""")
def cell_rates(spark, sf_dir):
    df = panel(spark, sf_dir)
    out = P.cell_rates(df.where(F.col("mes") <= 199812), df.where(F.col("mes") == 199901))
    return rounded(out.select(*KEYS, "cell_rate"))


@query("a32_entering_continuing", PANEL_SQL + """
SELECT mes, CAST(sum((mes = f)::INT) AS BIGINT) AS entering, CAST(sum((mes > f)::INT) AS BIGINT) AS continuing
FROM (SELECT mes, min(mes) OVER (PARTITION BY id_cliente) AS f FROM panel) GROUP BY 1""")
def entering_continuing(spark, sf_dir):
    return P.entering_and_continuing(panel(spark, sf_dir))


@query("a33_id_range_by_entry", PANEL_SQL + """
SELECT entry, min(id_cliente) AS min_id, max(id_cliente) AS max_id FROM (SELECT id_cliente, min(mes) AS entry FROM panel GROUP BY 1) GROUP BY 1""")
def id_range_by_entry(spark, sf_dir):
    return P.id_range_by_entry(panel(spark, sf_dir))


@query("a35_residual_table", SCORES_SQL + """
SELECT banda_riesgo, least(numero_productos, 3) AS products, count(*) AS n_rows, round(avg(objetivo), 9) AS observed, round(avg(m1), 9) AS expected,
  round(avg(objetivo - m1), 9) AS residual FROM scores GROUP BY 1, 2""")
def residual_table(spark, sf_dir):
    from cohortica.plans.panel import with_scores
    df = with_scores(panel(spark, sf_dir))
    return rounded(P.residual_table(df, ["banda_riesgo", X.capped("numero_productos", 3).alias("products")],
                                    "m1", "objetivo"))


@query("a37_timing_rollup", """
SELECT event_type, count(*) AS n_runs, round(avg(value), 6) AS mean_seconds, min(value) AS min_seconds, max(value) AS max_seconds FROM events GROUP BY 1""")
def timing_rollup(spark, sf_dir):
    from cohortica.sources.readers import read_table
    return P.timing_rollup(read_table(spark, sf_dir, "events"), ["event_type"], "value").withColumn(
        "mean_seconds", F.round("mean_seconds", 6))


@query("a40_rate_by_tenure", PANEL_SQL + """
SELECT CAST(least(k, 6) AS INT) AS k, count(*) AS n_rows, round(avg(objetivo), 9) AS rate, round(avg(c::INT), 9) AS copy_share FROM (
  SELECT objetivo, row_number() OVER (PARTITION BY id_cliente ORDER BY mes) AS k, dias_ultima_interaccion = dias_ultima_transaccion AS c FROM panel) GROUP BY 1""")
def rate_by_tenure(spark, sf_dir):
    return rounded(P.rate_by_tenure(panel(spark, sf_dir), 6, X.copy_flag(
        "dias_ultima_interaccion", "dias_ultima_transaccion")))


@query("a34_entity_overlap", PANEL_SQL + ", f AS (" + " UNION ALL ".join(
    f"SELECT {v} AS fold, id_cliente, CASE WHEN mes = {v} THEN 'valid' ELSE 'train' END AS role FROM panel WHERE mes <= {v}" for _, v in CUTS) + """)
SELECT fold, CAST(sum(t) AS BIGINT) AS train_entities, CAST(sum(v) AS BIGINT) AS valid_entities, CAST(sum(t * v) AS BIGINT) AS overlap FROM (
  SELECT fold, id_cliente, max((role = 'train')::INT) AS t, max((role = 'valid')::INT) AS v FROM f GROUP BY 1, 2) GROUP BY 1""")
def entity_overlap(spark, sf_dir):
    return P.entity_overlap(S.assign_folds(panel(spark, sf_dir).select(*KEYS), CUTS), "id_cliente")


# ------------------------------------------------------- sets, sorts, limits
@query("t3_leaderboard", SCORES_SQL + """
SELECT model, round(avg(score), 9) AS mean_score FROM long GROUP BY model ORDER BY avg(score) DESC, model LIMIT 2""")
def leaderboard(spark, sf_dir):
    from cohortica.operators.inference import leaderboard as top
    means = long_scores(scores(spark, sf_dir), ["m1", "m2", "m3"]).groupBy("model").agg(
        F.avg("score").alias("mean_score"))
    return rounded(top(means, "mean_score", "model", 2))


@query("t4_top_values", PANEL_SQL + "SELECT numero_productos, count(*) AS n_rows FROM panel GROUP BY 1 ORDER BY n_rows DESC, 1 LIMIT 3")
def top_values(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("numero_productos").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(
        F.desc("n_rows"), "numero_productos").limit(3)


@query("t1_stable_sort", PANEL_SQL + f"""
SELECT {K}, CAST(row_number() OVER (ORDER BY mes, id_cliente) - 1 AS BIGINT) AS position FROM panel""")
def stable_sort(spark, sf_dir):
    from cohortica.sources.readers import source_row_index
    return source_row_index(panel(spark, sf_dir).select(*KEYS), ["mes", "id_cliente"], "position")


@query("t5_order_statistics", SCORES_SQL + """
SELECT a.mes, a.p AS position, round(b.m2, 9) AS value FROM
  (SELECT mes, CAST(rank() OVER (PARTITION BY mes ORDER BY m3) - 1 AS BIGINT) AS p FROM scores) a
  JOIN (SELECT mes, m2, row_number() OVER (PARTITION BY mes ORDER BY m2) - 1 AS q FROM scores) b ON a.mes = b.mes AND a.p = b.q GROUP BY ALL""")
def order_statistics(spark, sf_dir):
    df = scores(spark, sf_dir)
    positions = value_ranks(df, ["mes"], "m3").select("mes", F.col("n_before").alias("position"))
    return rounded(lookup_positions(positions, df, ["mes"], "position", "m2", "value"))


@query("u1_labelled_union", TRAIN_SCORE_SQL + """
SELECT part, count(*) AS n_rows, CAST(sum(objetivo) AS BIGINT) AS events, CAST(max(k) AS INT) AS max_tenure FROM (
  SELECT *, row_number() OVER (PARTITION BY id_cliente ORDER BY mes) AS k FROM (
    SELECT 'train' AS part, id_cliente, mes, objetivo FROM train UNION ALL SELECT 'score', id_cliente, mes, NULL FROM score)) GROUP BY 1""")
def labelled_union(spark, sf_dir):
    train, score = train_score(spark, sf_dir)
    both = S.labelled_union(train, score).select(*KEYS, "part", "objetivo", H.months_in_panel().alias("k"))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("objetivo").alias("events"),
                                    F.max("k").alias("max_tenure"))


@query("u2_fold_union", SCORES_SQL + "SELECT CAST(mes AS INT) AS fold, count(*) AS n_rows FROM valid GROUP BY 1")
def fold_union(spark, sf_dir):
    folds = S.assign_folds(scores(spark, sf_dir), CUTS).where(F.col("role") == "valid")
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))


@query("u3_entity_intersection", PANEL_SQL + """
SELECT count(*) AS shared FROM (SELECT id_cliente FROM panel WHERE mes = 199901 INTERSECT SELECT id_cliente FROM panel WHERE mes = 199902)""")
def entity_intersection(spark, sf_dir):
    df = panel(spark, sf_dir)
    a, b = (df.where(F.col("mes") == m).select("id_cliente") for m in (199901, 199902))
    return a.intersect(b).agg(F.count(F.lit(1)).alias("shared"))


@query("u4_id_difference", PANEL_SQL + """
SELECT (SELECT count(*) FROM (SELECT id_cliente FROM panel WHERE mes = 199901 EXCEPT SELECT id_cliente FROM panel WHERE mes = 199902)) AS only_left,
  (SELECT count(*) FROM (SELECT id_cliente FROM panel WHERE mes = 199902 EXCEPT SELECT id_cliente FROM panel WHERE mes = 199901)) AS only_right""")
def id_difference(spark, sf_dir):
    df = panel(spark, sf_dir)
    a, b = (df.where(F.col("mes") == m).select("id_cliente") for m in (199901, 199902))
    return row_set_difference(a, b, ["id_cliente"])
