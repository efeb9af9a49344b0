"""Rank ensembles, weight search, selection and release gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortica.operators import ensemble as E
from cohortica.operators import inference as I
from cohortica.operators import metrics as M
from cohortica.plans.panel import (SCORE_MONTH, SCORES_SQL, TRAIN_THROUGH, gini_sql, long_scores,
                                   scores, valid_scores)
from cohortica.plans.q_features import K, KEYS, rounded
from cohortica.plans.q_metrics import MODELS, rank_sql
from cohortica.plans.registry import query
from cohortica.sources.readers import source_row_index

STEP = 0.1
CANDIDATES = {
    "pair": [(1.0, ["m1", "m2"])],
    "flat": [(1.0, ["m1"]), (1.0, ["m2"]), (1.0, ["m3"])],
    "half": [(0.5, ["m1", "m2"]), (0.5, ["m3"])],
}


def candidates_sql(source: str) -> str:
    return f"""
cr AS (SELECT id_cliente, mes, objetivo, {rank_sql('m1', 'mes')} AS r1, {rank_sql('m2', 'mes')} AS r2, {rank_sql('m3', 'mes')} AS r3 FROM {source}),
cg AS (SELECT *, round((r1 + r2) / 2, 12) AS g12 FROM cr),
ck AS (SELECT *, {rank_sql('g12', 'mes')} AS k12 FROM cg),
cand AS (SELECT 'pair' AS candidate, 0 AS priority, id_cliente, mes, objetivo, round(k12, 12) AS score FROM ck
  UNION ALL SELECT 'flat', 1, id_cliente, mes, objetivo, round((1.0::DOUBLE / 3) * r1 + (1.0::DOUBLE / 3) * r2 + (1.0::DOUBLE / 3) * r3, 12) FROM ck
  UNION ALL SELECT 'half', 2, id_cliente, mes, objetivo, round(0.5::DOUBLE * k12 + 0.5::DOUBLE * r3, 12) FROM ck)"""


@query("e1_rank_average", SCORES_SQL + f"""
SELECT {K}, round(({rank_sql('m1', 'mes')} + {rank_sql('m2', 'mes')} + {rank_sql('m3', 'mes')}) / 3, 9) AS blend FROM valid""")
def rank_average(spark, sf_dir):
    return rounded(E.rank_average(valid_scores(spark, sf_dir), MODELS).drop("objetivo"))


@query("e2_grouped_blend", SCORES_SQL + "," + candidates_sql("valid") + f"SELECT candidate, {K}, round(score, 9) AS score FROM cand")
def grouped_blend(spark, sf_dir):
    out = E.blend_candidates(valid_scores(spark, sf_dir), CANDIDATES, MODELS)
    return rounded(out.select("candidate", *KEYS, "score"))


@query("e3_probability_mean", SCORES_SQL + f"SELECT {K}, round(avg(score), 9) AS score, count(*) AS n_seeds FROM vlong GROUP BY 1, 2")
def probability_mean(spark, sf_dir):
    from cohortica.sources.readers import mean_over_seeds
    return rounded(mean_over_seeds(long_scores(valid_scores(spark, sf_dir), MODELS), KEYS))


@query("e4_fixed_blends", SCORES_SQL + f""",
rk AS (SELECT *, {rank_sql('m1', 'mes')} AS r1, {rank_sql('m3', 'mes')} AS r3 FROM valid),
bl AS (SELECT 'probability' AS method, w AS weight, mes, objetivo, round(w * m1 + (1 - w) * m3, 12) AS score FROM rk, (VALUES (0.75::DOUBLE), (0.5::DOUBLE), (0.25::DOUBLE)) t(w)
  UNION ALL SELECT 'rank', w, mes, objetivo, round(w * r1 + (1 - w) * r3, 12) FROM rk, (VALUES (0.75::DOUBLE), (0.5::DOUBLE), (0.25::DOUBLE)) t(w)),
{gini_sql('bl', 'method, weight, mes')}
SELECT method, weight, count(*) AS n_periods, round(avg(gini), 9) AS mean_gini, round(stddev_pop(gini), 9) AS std_gini FROM g GROUP BY 1, 2""")
def fixed_blends(spark, sf_dir):
    blends = E.fixed_blends(valid_scores(spark, sf_dir), "m1", "m3")
    return rounded(E.blend_summary(blends, ["method", "weight"]))


@query("e5_quantile_map", SCORES_SQL + f"""
SELECT a.id_cliente, a.mes, round(b.m2, 9) AS mapped FROM (SELECT *, rank() OVER (PARTITION BY mes ORDER BY m3) AS p FROM scores) a
JOIN (SELECT mes, m2, row_number() OVER (PARTITION BY mes ORDER BY m2) AS q FROM scores) b ON a.mes = b.mes AND p = q""")
def quantile_map(spark, sf_dir):
    return rounded(E.quantile_map(scores(spark, sf_dir), "m3", "m2").select(*KEYS, "mapped"))


GRID_SQL = SCORES_SQL + f""",
gr AS (SELECT a * 121 + b * 11 + (10 - a - b) AS weight_id, a / 10.0::DOUBLE AS w_m1, b / 10.0::DOUBLE AS w_m2, (10 - a - b) / 10.0::DOUBLE AS w_m3
  FROM generate_series(0, 10) x(a), generate_series(0, 10) y(b) WHERE a + b <= 10),
rr AS (SELECT mes, objetivo, {rank_sql('m1', 'mes')} AS r1, {rank_sql('m2', 'mes')} AS r2, {rank_sql('m3', 'mes')} AS r3 FROM valid),
gs AS (SELECT weight_id, mes, objetivo, round(r1 * w_m1 + r2 * w_m2 + r3 * w_m3, 12) AS score FROM rr, gr),
{gini_sql('gs', 'weight_id, mes')}"""


@query("e7_grid_weights", GRID_SQL + """
SELECT weight_id, round(w_m1, 9) AS w_m1, round(w_m2, 9) AS w_m2, round(w_m3, 9) AS w_m3, round(m, 9) AS mean_gini, m12 = max(m12) OVER () AND
  weight_id = min(CASE WHEN m12 = mx THEN weight_id END) OVER () AS best FROM (
  SELECT *, max(m12) OVER () AS mx FROM (SELECT weight_id, avg(gini) AS m, round(avg(gini), 12) AS m12 FROM g GROUP BY 1)) JOIN gr USING (weight_id)""")
def grid_weights(spark, sf_dir):
    """The whole grid with its mean Gini and the chosen point."""
    ginis = E.grid_ginis(valid_scores(spark, sf_dir), MODELS, STEP)
    grid = E.simplex_grid(spark, MODELS, STEP)
    best = E.fit_weights(ginis).select(F.col("weight_id").alias("_best"))
    means = ginis.groupBy("weight_id").agg(F.avg("gini").alias("mean_gini"))
    return rounded(means.join(grid, "weight_id").crossJoin(best).select(
        "weight_id", "w_m1", "w_m2", "w_m3", "mean_gini", (F.col("weight_id") == F.col("_best")).alias("best")))


@query("e8_leave_one_out_stack", GRID_SQL + """,
ot AS (SELECT h.mes AS held_out, g.weight_id, avg(g.gini) AS fit_gini FROM (SELECT DISTINCT mes FROM g) h JOIN g ON g.mes <> h.mes GROUP BY 1, 2),
bs AS (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY round(fit_gini, 12) DESC, weight_id) AS r FROM ot)
SELECT held_out, bs.weight_id, round(fit_gini, 9) AS fit_gini, round(g.gini, 9) AS held_out_gini FROM bs JOIN g ON g.mes = held_out AND g.weight_id = bs.weight_id WHERE r = 1""")
def leave_one_out_stack(spark, sf_dir):
    return rounded(E.leave_one_out_stack(E.grid_ginis(valid_scores(spark, sf_dir), MODELS, STEP)))


CAND_GINI_SQL = SCORES_SQL + "," + candidates_sql("valid") + f",\n{gini_sql('cand', 'candidate, priority, mes')}"


def candidate_ginis(spark, sf_dir):
    blends = E.blend_candidates(valid_scores(spark, sf_dir), CANDIDATES, MODELS)
    order = F.create_map(*[x for i, c in enumerate(CANDIDATES) for x in (F.lit(c), F.lit(i))])
    return M.auc_table(blends, ["candidate", "mes"]).withColumn("priority", order[F.col("candidate")])


@query("e9_leave_one_out_best", CAND_GINI_SQL + """,
ot AS (SELECT h.mes AS held_out, candidate, priority, avg(g.gini) AS fit FROM (SELECT DISTINCT mes FROM g) h JOIN g ON g.mes <> h.mes GROUP BY 1, 2, 3),
bs AS (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY round(fit, 12) DESC, priority) AS r FROM ot)
SELECT held_out, bs.candidate, round(g.gini, 9) AS held_out_gini FROM bs JOIN g ON g.mes = held_out AND g.candidate = bs.candidate WHERE r = 1""")
def leave_one_out_best(spark, sf_dir):
    return rounded(E.leave_one_out_best(candidate_ginis(spark, sf_dir)))


@query("e9_period_wins", CAND_GINI_SQL + """,
w AS (SELECT candidate, row_number() OVER (PARTITION BY mes ORDER BY round(gini, 12) DESC, priority) AS r FROM g)
SELECT candidate, count(*) FILTER (r = 1) AS wins FROM w GROUP BY 1""")
def period_wins(spark, sf_dir):
    return E.period_wins(candidate_ginis(spark, sf_dir))


@query("e10_agreement", SCORES_SQL + f""", sm AS (SELECT * FROM scores WHERE mes = {SCORE_MONTH}),{candidates_sql('sm')},
al AS (SELECT candidate, id_cliente, mes, score FROM cand UNION ALL SELECT 'current', id_cliente, mes, m1 FROM sm),
ra AS (SELECT *, {rank_sql('score', 'candidate, mes')} AS r FROM al)
SELECT x.mes, x.candidate AS a, y.candidate AS b, round(corr(x.r, y.r), 9) AS spearman FROM ra x JOIN ra y ON x.id_cliente = y.id_cliente AND x.mes = y.mes AND x.candidate < y.candidate GROUP BY 1, 2, 3""")
def agreement(spark, sf_dir):
    """E10 on the score month; a candidate with a missing member is left out."""
    df = scores(spark, sf_dir).where(F.col("mes") == SCORE_MONTH)
    ok, skipped = E.split_recipes({**CANDIDATES, "other": [(1.0, ["m9"])]}, df.columns)
    assert skipped == ["other"]
    return rounded(E.agreement(E.blend_candidates(df, ok, MODELS), df.withColumn("score", F.col("m1"))))


@query("e11_inner_selection", SCORES_SQL + f""",
{gini_sql('vlong', 'model, mes')}, mg AS (SELECT model AS name, CAST(substr(model, 2, 1) AS INT) AS priority, avg(gini) AS mean_gini FROM g GROUP BY 1)
SELECT name, priority, round(mean_gini, 9) AS mean_gini, mean_gini > (SELECT mean_gini FROM mg WHERE name = 'm2') AND name <> 'm2' AS helps,
  name = (SELECT name FROM mg ORDER BY round(mean_gini, 12) DESC, priority LIMIT 1) AS selected FROM mg""")
def inner_selection(spark, sf_dir):
    long = long_scores(valid_scores(spark, sf_dir), MODELS)
    means = M.monthly_summary(M.auc_table(long, ["model", "mes"]), ["model"]).select(
        F.col("model").alias("name"), F.substring("model", 2, 1).cast("int").alias("priority"), "mean_gini")
    return rounded(E.inner_selection(means, "m2"))


SEGMENT_SQL = f"""CASE WHEN id_cliente IN (SELECT id_cliente FROM scores WHERE mes <= {TRAIN_THROUGH}) THEN 'survivor'
  WHEN id_cliente > (SELECT max(id_cliente) FROM scores WHERE mes <= {TRAIN_THROUGH}) THEN 'new' ELSE 'other' END"""


@query("e12_release_gates", SCORES_SQL + f""",
sm AS (SELECT *, {SEGMENT_SQL} AS segment FROM scores WHERE mes = {SCORE_MONTH}),
r AS (SELECT *, {rank_sql('m1', 'mes')} AS r1, {rank_sql('m2', 'mes')} AS r2, {rank_sql('m1', 'segment')} AS s1, {rank_sql('m2', 'segment')} AS s2 FROM sm),
sg AS (SELECT corr(s1, s2) AS rho, avg(m1) AS mean FROM r WHERE segment = 'survivor')
SELECT 'G1' AS gate, (SELECT corr(r1, r2) BETWEEN 0.8 AND 0.95 FROM r) AS passed, round((SELECT corr(r1, r2) FROM r), 9) AS main_evidence, round((SELECT rho FROM sg), 9) AS survivor_evidence
UNION ALL SELECT 'G2', (SELECT corr(r1, r2) BETWEEN 0.8 AND 0.95 FROM r) AND (SELECT stddev_pop(m1) > 0.01 FROM sm), round((SELECT stddev_pop(m1) * 0.99 FROM sm), 9), NULL
UNION ALL SELECT 'G3', (SELECT stddev_pop(m1) > 0.01 FROM sm), round((SELECT stddev_pop(m1) FROM sm), 9), round((SELECT mean FROM sg), 9)
UNION ALL SELECT 'G4', true, 0.0, NULL""")
def release_gates(spark, sf_dir):
    """The four gates on the score month; G1 and G3 also by segment."""
    everything = scores(spark, sf_dir)
    df = E.segments(everything.where(F.col("mes") == SCORE_MONTH), everything.where(F.col("mes") <= TRAIN_THROUGH), "id_cliente")
    indexed = source_row_index(df, ["id_cliente"])
    members = df.select("id_cliente", F.col("m1").alias("n1"), F.col("m2").alias("b0"), "segment")
    # Three seeds around the column whose mean is the column.
    shift = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(k).alias("k"))
                                for s, k in ((42, 0.99), (43, 1.0), (44, 1.01))]))
    seeds = df.select("id_cliente", "m1", shift.alias("_s")).select(
        "id_cliente", "_s.seed", (F.col("m1") * F.col("_s.k")).alias("score"))
    submission = indexed.select("row_ord", "id_cliente", F.col("m1").alias("prediccion"))
    gates = E.release_gates(members, seeds, submission, indexed.select("row_ord", "id_cliente"), (42, 43, 44), segment="segment")
    pick = lambda **keys: F.round(F.col("evidence")[F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])[F.col("gate")]], 9)
    return gates.select("gate", "passed", pick(G1="spearman", G2="min_std", G3="std", G4="violations").alias("main_evidence"),
                        pick(G1="spearman_survivor", G3="mean_survivor").alias("survivor_evidence"))


@query("e13_pre_release_checks", SCORES_SQL + f""",
seg AS (SELECT m1, m2, CASE WHEN id_cliente IN (SELECT id_cliente FROM scores WHERE mes <= {TRAIN_THROUGH}) THEN 'survivor'
  WHEN id_cliente > (SELECT max(id_cliente) FROM scores WHERE mes <= {TRAIN_THROUGH}) THEN 'new' ELSE 'other' END AS segment FROM scores WHERE mes = {SCORE_MONTH}),
r AS (SELECT *, {rank_sql('m1', 'segment')} AS r1, {rank_sql('m2', 'segment')} AS r2 FROM seg)
SELECT segment, count(*) AS n_rows, round(avg(m1), 9) AS mean, CAST(0 AS BIGINT) AS not_finite, count(*) FILTER (m1 < 0 OR m1 > 1) AS outside_unit,
  CASE WHEN count(*) > 1 THEN round(corr(r1, r2), 9) END AS spearman FROM r GROUP BY 1""")
def pre_release_checks(spark, sf_dir):
    df = scores(spark, sf_dir)
    seg = E.segments(df.where(F.col("mes") == SCORE_MONTH), df.where(F.col("mes") <= TRAIN_THROUGH), "id_cliente")
    return rounded(E.pre_release_checks(seg, "m1", "m2").select(
        "segment", "n_rows", "mean", "not_finite", "outside_unit", "spearman"))


@query("e14_model_diversity", SCORES_SQL + f""",
r AS (SELECT mes, m1, m2, m3, {rank_sql('m1', 'mes')} AS r1, {rank_sql('m2', 'mes')} AS r2, {rank_sql('m3', 'mes')} AS r3 FROM valid)
SELECT 'm2' AS model, mes, round(corr(m1, m2), 9) AS pearson, round(corr(r1, r2), 9) AS spearman FROM r GROUP BY mes
UNION ALL SELECT 'm3', mes, round(corr(m1, m3), 9), round(corr(r1, r3), 9) FROM r GROUP BY mes""")
def model_diversity(spark, sf_dir):
    df = valid_scores(spark, sf_dir)
    long = df.unpivot([*KEYS, "m1"], ["m2", "m3"], "model", "score")
    return rounded(M.correlation(long, "m1", "score", ["model", "mes"]).select("model", "mes", "pearson", "spearman"))


@query("snk5_rounded_oof_wide", SCORES_SQL + f"SELECT {K}, objetivo, round(m1, 7) AS m1, round(m2, 7) AS m2, round(m3, 7) AS m3 FROM valid")
def rounded_oof(spark, sf_dir):
    from cohortica.sources.sinks import wide_oof
    return wide_oof(long_scores(valid_scores(spark, sf_dir), MODELS), MODELS)
