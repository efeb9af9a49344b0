"""Ranking metrics over the stand-in scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortica.functions.ordered import add_ranks, pct_ranks
from cohortica.operators import metrics as M
from cohortica.plans.panel import (PANEL_SQL, SCORES_SQL, gini_sql, long_scores, panel, scores,
                                   valid_scores, with_scores)
from cohortica.plans.registry import query
from cohortica.spec import NUMERIC_COLUMNS

MODELS = ["m1", "m2", "m3"]


def r9(name: str, digits: int = 9):
    return F.round(name, digits).alias(name)


def rank_sql(value: str, by: str) -> str:
    """Average-tie percentile rank of a column as SQL."""
    return (f"((rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value})"
            f" - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {by}))")


@query("a19_monthly_blend_gini", SCORES_SQL + f""",
b AS (SELECT mes, objetivo, round(({rank_sql('m1','mes')} + {rank_sql('m2','mes')} + {rank_sql('m3','mes')}) / 3, 12) AS score FROM scores),
{gini_sql('b', 'mes')}
SELECT mes, n_rows, events, round(gini, 9) AS gini FROM g""")
def monthly_blend_gini(spark, sf_dir):
    df = scores(spark, sf_dir)
    ranks = pct_ranks(df, ["id_cliente", "mes", "objetivo"], ["mes"], MODELS)
    blend = ranks.withColumn("score", F.round(
        (F.col("rk_m1") + F.col("rk_m2") + F.col("rk_m3")) / F.lit(3), 12))
    return M.auc_table(blend, ["mes"]).select("mes", "n_rows", "events", r9("gini"))


@query("w9_within_month_rank", SCORES_SQL + f"""
SELECT id_cliente, mes, round({rank_sql('m1','mes')}, 12) AS rk_m1, round({rank_sql('m3','mes')}, 12) AS rk_m3 FROM scores""")
def within_month_rank(spark, sf_dir):
    df = scores(spark, sf_dir)
    ranked = add_ranks(df, ["mes"], {"m1": "rk_m1", "m3": "rk_m3"})
    return ranked.select("id_cliente", "mes", r9("rk_m1", 12), r9("rk_m3", 12))


@query("a17_monthly_gini", SCORES_SQL + f""",
{gini_sql('long', 'model, mes')}
SELECT model, mes, n_rows, events, round(auc, 9) AS auc, round(gini, 9) AS gini FROM g""")
def monthly_gini(spark, sf_dir):
    long = long_scores(scores(spark, sf_dir), MODELS)
    return M.auc_table(long, ["model", "mes"]).select(
        "model", "mes", "n_rows", "events", r9("auc"), r9("gini"))


@query("a18_average_precision", SCORES_SQL + f""",
{gini_sql('long', 'model, mes')}
SELECT model, mes, round(ap, 9) AS ap FROM g""")
def average_precision(spark, sf_dir):
    long = long_scores(scores(spark, sf_dir), MODELS)
    return M.average_precision(long, ["model", "mes"]).select("model", "mes", r9("ap"))


@query("a19_monthly_summary", SCORES_SQL + f""",
{gini_sql('long', 'model, mes')}
SELECT model, count(gini) AS n_periods, round(avg(gini), 9) AS mean_gini, round(stddev_pop(gini), 9) AS std_gini, count(*) FILTER (gini IS NULL) AS undefined_periods FROM g GROUP BY model""")
def monthly_summary(spark, sf_dir):
    """A19 over all months; those with one class are counted, not dropped unseen."""
    long = long_scores(scores(spark, sf_dir), MODELS)
    return M.monthly_summary(M.auc_table(long, ["model", "mes"]), ["model"], undefined="report").select(
        "model", "n_periods", r9("mean_gini"), r9("std_gini"), "undefined_periods")


@query("a20_metric_slices", SCORES_SQL + f""",
h AS (SELECT *, min(mes) OVER (PARTITION BY id_cliente) < mes AS rec FROM scores),
sl AS (SELECT 'overall' AS slice, 'all' AS value, objetivo, m1 FROM h WHERE mes IN (199901, 199902, 199903)
  UNION ALL SELECT 'period', CAST(mes AS VARCHAR), objetivo, m1 FROM h WHERE mes IN (199901, 199902, 199903)
  UNION ALL SELECT 'cohort', CASE WHEN rec THEN 'recurrent' ELSE 'new' END, objetivo, m1 FROM h WHERE mes IN (199901, 199902, 199903)),
{gini_sql('sl', 'slice, value', 'm1')}
SELECT slice, value, n_rows, events, round(auc, 9) AS auc, round(gini, 9) AS gini, round(ap, 9) AS ap FROM g""")
def metric_slices(spark, sf_dir):
    from cohortica.operators.history import add_history
    from cohortica.plans.panel import VALID_MONTHS
    df = add_history(scores(spark, sf_dir)).where(F.col("mes").isin(VALID_MONTHS))
    out = M.metric_slices(df, "mes", "cliente_recurrente", "m1")
    return out.select("slice", "value", "n_rows", "events", r9("auc"), r9("gini"), r9("ap"))


@query("a21_pooled_gini", SCORES_SQL + f""",
{gini_sql('vlong', 'model')}
SELECT model, n_rows, events, round(gini, 9) AS gini FROM g""")
def pooled_gini(spark, sf_dir):
    return M.auc_table(long_scores(valid_scores(spark, sf_dir), MODELS), ["model"]).select(
        "model", "n_rows", "events", r9("gini"))


@query("a22_weighted_gini", SCORES_SQL + f""",
wt AS (SELECT *, 1 + id_cliente % 3 AS w FROM long),
{gini_sql('wt', 'model, mes', weight='w')}
SELECT model, mes, round(gini, 9) AS gini FROM g""")
def weighted_gini(spark, sf_dir):
    long = long_scores(scores(spark, sf_dir), MODELS).withColumn("w", 1 + F.col("id_cliente") % 3)
    return M.auc_table(long, ["model", "mes"], weight="w").select("model", "mes", r9("gini"))


SCREEN = NUMERIC_COLUMNS


@query("a23_univariate_screen", PANEL_SQL + ", u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, objetivo FROM panel" for c in SCREEN) + f"),\n{gini_sql('u', 'feature', 'value')}\n"
    + "SELECT feature, n_rows, events, round(gini, 9) AS gini FROM g")
def univariate_screen(spark, sf_dir):
    return M.univariate_screen(panel(spark, sf_dir), SCREEN, "objetivo").select(
        "feature", "n_rows", "events", r9("gini"))


@query("a24_conditional_gini", PANEL_SQL + f""",
c AS (SELECT dias_ultima_interaccion = dias_ultima_transaccion AS is_copy, dias_ultima_interaccion AS v, objetivo FROM panel),
{gini_sql('c', 'is_copy', 'v')}
SELECT is_copy, n_rows, round(-gini, 9) AS gini FROM g""")
def conditional_gini(spark, sf_dir):
    df = panel(spark, sf_dir).select(
        (F.col("dias_ultima_interaccion") == F.col("dias_ultima_transaccion")).alias("is_copy"),
        (-F.col("dias_ultima_interaccion")).alias("v"), "objetivo")
    return M.auc_table(df, ["is_copy"], "v").select("is_copy", "n_rows", r9("gini"))


QS = {"p1": 0.01, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


@query("a25_score_distribution", SCORES_SQL + """
SELECT count(*) AS n_rows, round(avg(m1), 9) AS mean, round(stddev_pop(m1), 9) AS std, round(min(m1), 9) AS min, round(max(m1), 9) AS max, """
       + ", ".join(f"round(quantile_cont(m1, {p}), 9) AS {n}" for n, p in QS.items()) + " FROM scores")
def score_distribution(spark, sf_dir):
    out = M.score_distribution(scores(spark, sf_dir), "m1", QS)
    return out.select("n_rows", *[r9(c) for c in out.columns if c != "n_rows"])


@query("a26_segment_describe", SCORES_SQL + """,
seg AS (SELECT m1, CASE WHEN id_cliente IN (SELECT id_cliente FROM scores WHERE mes <= 200012) THEN 'survivor'
  WHEN id_cliente > (SELECT max(id_cliente) FROM scores WHERE mes <= 200012) THEN 'new' ELSE 'other' END AS segment FROM scores WHERE mes = 200101)
SELECT segment, count(*) AS n_rows, round(avg(m1), 9) AS mean, round(quantile_cont(m1, 0.1), 9) AS p10, round(quantile_cont(m1, 0.5), 9) AS p50, round(quantile_cont(m1, 0.9), 9) AS p90
FROM seg GROUP BY 1""")
def segment_describe(spark, sf_dir):
    from cohortica.operators.ensemble import segments
    df = scores(spark, sf_dir)
    seg = segments(df.where(F.col("mes") == 200101), df.where(F.col("mes") <= 200012), "id_cliente")
    out = M.score_distribution(seg, "m1", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["segment"])
    return out.select("segment", "n_rows", *[r9(c) for c in ("mean", "p10", "p50", "p90")])


@query("a27_score_correlation", SCORES_SQL + f""",
r AS (SELECT mes, m1, m2, {rank_sql('m1', 'mes')} AS ra, {rank_sql('m2', 'mes')} AS rb FROM scores)
SELECT mes, count(*) AS n_rows, round(corr(m1, m2), 9) AS pearson, round(corr(ra, rb), 9) AS spearman FROM r GROUP BY mes""")
def score_correlation(spark, sf_dir):
    return M.correlation(scores(spark, sf_dir), "m1", "m2", ["mes"]).select(
        "mes", "n_rows", r9("pearson"), r9("spearman"))


@query("a28_ks_uniform", PANEL_SQL + """,
x AS (SELECT (dias_ultima_interaccion - 0.5::DOUBLE) / 364.0::DOUBLE AS x FROM panel WHERE dias_ultima_interaccion <> dias_ultima_transaccion),
o AS (SELECT x, row_number() OVER (ORDER BY x) AS i, (SELECT count(*) FROM x) AS n FROM x)
SELECT max(n) AS n_rows, round(max(greatest(i / CAST(n AS DOUBLE) - x, x - (i - 1) / CAST(n AS DOUBLE))), 9) AS ks FROM o""")
def ks_uniform(spark, sf_dir):
    df = panel(spark, sf_dir).where(
        F.col("dias_ultima_interaccion") != F.col("dias_ultima_transaccion")).select(
        ((F.col("dias_ultima_interaccion") - F.lit(0.5)) / F.lit(364.0)).alias("x"))
    return M.ks_uniform(df, "x").select("n_rows", r9("ks"))


@query("a36_calibration", SCORES_SQL + """
SELECT mes, count(*) AS n_rows, round(avg(m1), 9) AS mean_score, round(avg(objetivo), 9) AS event_rate, round(avg(objetivo - m1), 9) AS mean_residual FROM scores GROUP BY mes""")
def calibration(spark, sf_dir):
    return M.calibration(scores(spark, sf_dir), "m1", "objetivo", ["mes"]).select(
        "mes", "n_rows", r9("mean_score"), r9("event_rate"), r9("mean_residual"))


@query("a38_direction_evidence", PANEL_SQL + ", e AS (SELECT objetivo, " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}"
    for c in ("numero_productos", "dias_ultima_transaccion", "ingresos")) + " FROM panel WHERE mes <= 199908) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, objetivo), 9) AS spearman FROM e"
                         for c in ("numero_productos", "dias_ultima_transaccion", "ingresos")))
def direction_evidence(spark, sf_dir):
    """Rank correlation of features with the label up to a cutoff."""
    columns = ["numero_productos", "dias_ultima_transaccion", "ingresos"]
    df = panel(spark, sf_dir).where(F.col("mes") <= 199908)
    long = df.select("objetivo", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["objetivo"], columns, "feature", "value")
    return M.correlation(long, "value", "objetivo", ["feature"]).select("feature", r9("spearman"))


@query("a39_seed_spread", SCORES_SQL + f""",
sd AS (SELECT seed, mes, objetivo, CASE WHEN (id_cliente + seed) % 3 = 0 THEN m2 ELSE m1 END AS score FROM valid, (VALUES (42), (43), (44)) s(seed)),
{gini_sql('sd', 'seed, mes')},
ps AS (SELECT seed, avg(gini) AS mg FROM g GROUP BY seed)
SELECT 'mix' AS model, count(*) AS n_seeds, round(avg(mg), 9) AS mean, round(stddev_samp(mg), 9) AS std, round(min(mg), 9) AS min, round(max(mg), 9) AS max FROM ps""")
def seed_spread(spark, sf_dir):
    df = valid_scores(spark, sf_dir).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in (42, 43, 44)])))
    mixed = df.select("seed", "mes", "objetivo", F.lit("mix").alias("model"), F.when(
        (F.col("id_cliente") + F.col("seed")) % 3 == 0, F.col("m2")).otherwise(F.col("m1")).alias("score"))
    out = M.seed_spread(mixed, "model", "seed", "mes", "score", "objetivo")
    return out.select("model", "n_seeds", r9("mean"), r9("std"), r9("min"), r9("max"))
