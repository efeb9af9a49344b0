"""Bootstrap, multiplicity and decision-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortica.operators import inference as I
from cohortica.operators import metrics as M
from cohortica.operators.history import add_history
from cohortica.functions.hashing import entity_bucket
from cohortica.plans.panel import SCORES_SQL, VALID_MONTHS, gini_sql, long_scores, scores, valid_scores
from cohortica.plans.q_features import rounded
from cohortica.plans.q_metrics import MODELS, rank_sql
from cohortica.plans.q_splits import hash_int_sql, uniform_sql
from cohortica.plans.registry import query

R, SEED = 1000, 42


def boot_sql(source: str, name: str = "bw", replicates: int = R, seed: int = SEED) -> str:
    return f"""
{name}_e AS (SELECT id_cliente, row_number() OVER (ORDER BY id_cliente) - 1 AS pos FROM (SELECT DISTINCT id_cliente FROM {source})),
{name} AS (SELECT CAST(r AS INT) AS replicate, e.id_cliente, CAST(c AS INT) AS weight FROM (
  SELECT r, {hash_int_sql(seed, 'r', 'pos')} % (SELECT count(*) FROM {name}_e) AS pos, count(*) AS c
  FROM {name}_e, generate_series(0, {replicates - 1}) g(r) GROUP BY 1, 2) d JOIN {name}_e e USING (pos))"""


DRAWS_SQL = SCORES_SQL + "," + boot_sql("vlong") + f""",
wl AS (SELECT replicate, model, mes, objetivo, score, weight FROM vlong JOIN bw USING (id_cliente)),
{gini_sql('wl', 'replicate, model, mes', weight='weight', name='ag')},
dg AS (SELECT * FROM ag WHERE replicate NOT IN (SELECT replicate FROM ag WHERE gini IS NULL)),
{gini_sql('vlong', 'model, mes', name='og')}"""

DELTA_SQL = DRAWS_SQL + """,
prs AS (SELECT * FROM pairs_),
per AS (SELECT x.replicate, p.a, p.b, CAST(x.mes AS VARCHAR) AS period, x.gini - y.gini AS draw FROM prs p JOIN dg x ON x.model = p.a JOIN dg y ON y.model = p.b AND y.mes = x.mes AND y.replicate = x.replicate),
obs AS (SELECT p.a, p.b, CAST(x.mes AS VARCHAR) AS period, x.gini - y.gini AS o FROM prs p JOIN og x ON x.model = p.a JOIN og y ON y.model = p.b AND y.mes = x.mes),
alld AS (SELECT * FROM per UNION ALL SELECT replicate, a, b, 'mean', avg(draw) FROM per GROUP BY 1, 2, 3),
allo AS (SELECT * FROM obs UNION ALL SELECT a, b, 'mean', avg(o) FROM obs GROUP BY 1, 2),
jn AS (SELECT alld.*, o, avg(draw) OVER (PARTITION BY alld.a, alld.b, alld.period) AS mid FROM alld JOIN allo USING (a, b, period) WHERE draw IS NOT NULL AND o IS NOT NULL),
sm AS (SELECT a, b, period, max(o) AS delta, quantile_cont(draw, 0.025) AS ci_low, quantile_cont(draw, 0.975) AS ci_high, avg((draw > 0)::INT) AS p_positive,
  (1 + count(*) FILTER (round(abs(draw - center_), 12) >= round(abs(o), 12))) / CAST(count(*) + 1 AS DOUBLE) AS p_two_sided, count(*) AS draws FROM jn GROUP BY 1, 2, 3),
hm AS (SELECT a, b, period, max(st) OVER (ORDER BY round(p_two_sided, 12), a, b) AS p_holm FROM (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY round(p_two_sided, 12), a, b) + 1) * round(p_two_sided, 12)) AS st FROM sm WHERE period = 'mean'))
SELECT a, b, period, round(delta, 9) AS delta, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(p_positive, 9) AS p_positive,
  round(p_two_sided, 9) AS p_two_sided, draws, round(p_holm, 9) AS p_holm FROM sm LEFT JOIN hm USING (a, b, period)"""
VS_M1 = "(SELECT 'm2' AS a, 'm1' AS b UNION ALL SELECT 'm3', 'm1')"
ALL_PAIRS = "(SELECT 'm1' AS a, 'm2' AS b UNION ALL SELECT 'm1', 'm3' UNION ALL SELECT 'm2', 'm3')"


def delta_sql(pairs: str, center: str) -> str:
    return DELTA_SQL.replace("pairs_", pairs).replace("center_", center)


def drawn(spark, sf_dir):
    long = long_scores(valid_scores(spark, sf_dir), MODELS)
    return I.usable_draws(I.bootstrap_ginis(long, R, SEED, observed=True))


@query("b0_entity_weights", SCORES_SQL + "," + boot_sql("valid") + "SELECT replicate, id_cliente, weight FROM bw")
def entity_weights(spark, sf_dir):
    return I.entity_weights(valid_scores(spark, sf_dir), R, SEED)


@query("b0_poisson_weights", SCORES_SQL + f""",
e AS (SELECT DISTINCT id_cliente FROM valid), u AS (SELECT CAST(r AS INT) AS replicate, id_cliente, {uniform_sql(SEED, 'r', 'id_cliente')} AS u FROM e, generate_series(0, 4) g(r)),
cdf AS (SELECT k, sum(exp(-1.0::DOUBLE) / factorial(k)) OVER (ORDER BY k) AS c FROM (SELECT CAST(k AS INT) AS k FROM generate_series(0, 12) t(k)))
SELECT replicate, id_cliente, CAST(count(*) AS INT) AS weight FROM u JOIN cdf ON u >= c GROUP BY 1, 2""")
def poisson_weights(spark, sf_dir):
    return I.entity_weights(valid_scores(spark, sf_dir), 5, SEED, "poisson")


@query("b1_pooled_delta", SCORES_SQL + "," + boot_sql("valid") + f""",
w2 AS (SELECT replicate, model, objetivo, score, weight FROM vlong JOIN bw USING (id_cliente) WHERE model IN ('m1', 'm3')),
{gini_sql('w2', 'replicate, model', weight='weight', name='dg')}, {gini_sql('vlong', 'model', name='og')},
d AS (SELECT x.gini - y.gini AS d FROM dg x JOIN dg y USING (replicate) WHERE x.model = 'm1' AND y.model = 'm3' AND x.gini IS NOT NULL AND y.gini IS NOT NULL)
SELECT round((SELECT gini FROM og WHERE model = 'm1') - (SELECT gini FROM og WHERE model = 'm3'), 9) AS delta_gini,
  round(quantile_cont(d, 0.025), 9) AS ci95_low, round(quantile_cont(d, 0.975), 9) AS ci95_high, count(*) AS bootstrap_replicates FROM d""")
def pooled_delta(spark, sf_dir):
    return rounded(I.pooled_delta(valid_scores(spark, sf_dir), "m1", "m3", R, SEED))


@query("b2_bootstrap_ginis", DRAWS_SQL + "SELECT replicate, model, mes, round(gini, 9) AS gini FROM ag")
def bootstrap_ginis(spark, sf_dir):
    """B2 and J14; a draw without one of the classes has a NULL Gini."""
    return rounded(I.bootstrap_ginis(long_scores(valid_scores(spark, sf_dir), MODELS), R, SEED))


@query("b3_delta_vs_baseline", delta_sql(VS_M1, "o"))
def delta_vs_baseline(spark, sf_dir):
    """B3 and W16."""
    return rounded(I.delta_table(drawn(spark, sf_dir), I.pairs_against(MODELS, "m1")))


@query("b4_all_pairs", delta_sql(ALL_PAIRS, "o"))
def all_pairs(spark, sf_dir):
    return rounded(I.delta_table(drawn(spark, sf_dir), I.all_pairs(MODELS)))


@query("b5_two_baselines", DRAWS_SQL + """,
mm AS (SELECT replicate, model, avg(gini) AS g FROM dg GROUP BY 1, 2), om AS (SELECT model, avg(gini) AS g FROM og GROUP BY 1)
SELECT c AS candidate, round(max(d) FILTER (base = 'm1'), 9) AS delta_vs_m1, round(max(lo) FILTER (base = 'm1'), 9) AS ci_low_vs_m1,
  round(max(d) FILTER (base = 'm2'), 9) AS delta_vs_m2, round(max(lo) FILTER (base = 'm2'), 9) AS ci_low_vs_m2 FROM (
  SELECT x.model AS c, y.model AS base, max(ox.g - oy.g) AS d, quantile_cont(x.g - y.g, 0.025) AS lo FROM mm x JOIN mm y USING (replicate)
  JOIN om ox ON ox.model = x.model JOIN om oy ON oy.model = y.model WHERE y.model IN ('m1', 'm2') AND x.model <> y.model GROUP BY 1, 2) GROUP BY 1""")
def two_baselines(spark, sf_dir):
    """B5 and J10."""
    out = I.two_baselines(drawn(spark, sf_dir), MODELS, "m1", "m2")
    return rounded(out.select("candidate", "delta_vs_m1", "ci_low_vs_m1", "delta_vs_m2", "ci_low_vs_m2"))


@query("b6_probability_of_best", DRAWS_SQL + """,
mm AS (SELECT replicate, model, avg(gini) AS v FROM dg GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN max(v) OVER (PARTITION BY replicate) - v <= 1e-12 THEN 1 ELSE 0 END AS win FROM mm)
SELECT model, round(avg(s), 9) AS p_best FROM (SELECT model, win / CAST(sum(win) OVER (PARTITION BY replicate) AS DOUBLE) AS s FROM w) GROUP BY model""")
def probability_of_best(spark, sf_dir):
    return rounded(I.probability_of_best(drawn(spark, sf_dir)))


@query("b7_mean_centred", delta_sql(VS_M1, "mid"))
def mean_centred(spark, sf_dir):
    return rounded(I.delta_table(drawn(spark, sf_dir), I.pairs_against(MODELS, "m1"), center="mean"))


HELD = "CAST('0x' || substr(sha256(CAST(id_cliente AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0"


@query("b8_identifier_gate", SCORES_SQL + f""",
hv AS (SELECT * FROM valid WHERE {HELD}),{boot_sql('valid', 'bw')},{boot_sql('hv', 'hb')},
w2 AS (SELECT replicate, model, objetivo, score, weight FROM vlong JOIN bw USING (id_cliente) WHERE model IN ('m1', 'm3')),
h2 AS (SELECT replicate, model, objetivo, score, weight FROM vlong JOIN hb USING (id_cliente) WHERE model IN ('m1', 'm3')),
{gini_sql('w2', 'replicate, model', weight='weight', name='dg')}, {gini_sql('h2', 'replicate, model', weight='weight', name='dh')},
co AS (SELECT model, score, objetivo, min(mes) OVER (PARTITION BY id_cliente, model) < mes AS rec, mes FROM long),
cv AS (SELECT * FROM co WHERE mes IN (199901, 199902, 199903)), {gini_sql('cv', 'rec, model', name='cg')},
f AS (SELECT (SELECT quantile_cont(x.gini - y.gini, 0.025) > 0 FROM dg x JOIN dg y USING (replicate) WHERE x.model = 'm1' AND y.model = 'm3') AS temporal_ok,
  (SELECT quantile_cont(x.gini - y.gini, 0.025) > 0 FROM dh x JOIN dh y USING (replicate) WHERE x.model = 'm1' AND y.model = 'm3') AS held_out_ok,
  coalesce((SELECT min(x.gini - y.gini) >= 0 FROM cg x JOIN cg y USING (rec) WHERE x.model = 'm1' AND y.model = 'm3'), true) AS cohorts_ok)
SELECT *, temporal_ok AND held_out_ok AND cohorts_ok AS passed FROM f""")
def identifier_gate(spark, sf_dir):
    df = add_history(scores(spark, sf_dir)).where(F.col("mes").isin(VALID_MONTHS))
    temporal = I.pooled_delta(df, "m1", "m3", R, SEED)
    held = I.pooled_delta(df.where(entity_bucket("id_cliente", 5) == 0), "m1", "m3", R, SEED)
    long = df.unpivot(["cliente_recurrente", "objetivo"], ["m1", "m3"], "model", "score")
    cohorts = M.auc_table(long, ["cliente_recurrente", "model"]).groupBy("cliente_recurrente").agg(
        (F.max(F.when(F.col("model") == "m1", F.col("gini")))
         - F.max(F.when(F.col("model") == "m3", F.col("gini")))).alias("delta"))
    return I.gate(temporal, held, cohorts)


INNER = (199809, 199810, 199811, 199812)


@query("b9_conclusive_winner", SCORES_SQL + "," + boot_sql("valid") + f""",
il AS (SELECT * FROM long WHERE mes IN {INNER}), {gini_sql('il', 'model, mes', name='ig')},
fin AS (SELECT model, row_number() OVER (ORDER BY avg(gini) DESC, model) AS place FROM ig GROUP BY model),
cha AS (SELECT model FROM fin WHERE place = 1), run AS (SELECT model FROM fin WHERE place = 2),
w2 AS (SELECT replicate, model, objetivo, score, weight FROM vlong JOIN bw USING (id_cliente)),
{gini_sql('w2', 'replicate, model', weight='weight', name='dg')}, {gini_sql('vlong', 'model', name='og')},
hv AS (SELECT l.*, min(mes) OVER (PARTITION BY id_cliente) < mes AS rec FROM long l WHERE model = (FROM cha)),
hw AS (SELECT * FROM hv WHERE mes IN (199901, 199902, 199903)),
{gini_sql('hw', 'mes', name='pg')}, {gini_sql('hw', 'rec', name='cg')},
q AS (SELECT (SELECT gini FROM og WHERE model = (FROM cha)) - (SELECT gini FROM og WHERE model = (FROM run)) AS delta_gini,
  (SELECT quantile_cont(x.gini - y.gini, 0.025) FROM dg x JOIN dg y USING (replicate) WHERE x.model = (FROM cha) AND y.model = (FROM run)) AS ci95_low)
SELECT (FROM cha) AS champion, (FROM run) AS runner_up, round(delta_gini, 9) AS delta_gini, round(ci95_low, 9) AS ci95_low, CASE WHEN ci95_low > 0
  AND (SELECT min(gini) > 0 FROM pg) AND (SELECT min(gini) >= 0 FROM cg) THEN 'conclusive_winner' ELSE 'no_conclusive_winner' END AS status FROM q""")
def conclusive_winner(spark, sf_dir):
    """The two best of the inner months meet on the holdout months."""
    df = add_history(scores(spark, sf_dir))
    inner = M.auc_table(long_scores(df.where(F.col("mes").isin(*INNER)), MODELS), ["model", "mes"])
    means = inner.groupBy("model").agg(F.avg("gini").alias("mean_gini")).withColumn("eligible", F.lit(True))
    return rounded(I.outer_winner(means, df.where(F.col("mes").isin(VALID_MONTHS)), "cliente_recurrente", R, SEED))


@query("b10_promotion_label", SCORES_SQL + f""",
{gini_sql('vlong', 'model, mes')}, mg AS (SELECT model, avg(gini) AS m FROM g GROUP BY 1),
r AS (SELECT mes, {rank_sql('m1', 'mes')} AS ra, {rank_sql('m2', 'mes')} AS rb, {rank_sql('m3', 'mes')} AS rc FROM valid),
sp AS (SELECT 'm2' AS model, avg(c) AS s FROM (SELECT corr(ra, rb) AS c FROM r GROUP BY mes) UNION ALL SELECT 'm3', avg(c) FROM (SELECT corr(ra, rc) AS c FROM r GROUP BY mes))
SELECT model, CASE WHEN m > 0.253 THEN 'promote' WHEN m > 0.251 THEN 'competitive' WHEN m - 0.01 > 0.05 THEN 'ensemble-only (blend)'
  WHEN m >= 0.248 AND s < 0.95 THEN 'ensemble-only' ELSE 'reject' END AS label FROM mg JOIN sp USING (model)""")
def promotion(spark, sf_dir):
    df = valid_scores(spark, sf_dir)
    means = M.monthly_summary(M.auc_table(long_scores(df, MODELS), ["model", "mes"]), ["model"])
    parts = [M.correlation(df, "m1", m, ["mes"]).agg(F.avg("spearman").alias("s")).select(
        F.lit(m).alias("model"), "s") for m in ("m2", "m3")]
    table = means.join(parts[0].unionByName(parts[1]), "model")
    label = I.promotion_label(F.col("mean_gini"), F.col("mean_gini") - 0.01, F.col("s"), 0.05)
    return table.select("model", label.alias("label"))


@query("t2_best_candidate", SCORES_SQL + f""",
{gini_sql('long', 'model, mes')}
SELECT mes, arg_min(model, (-round(gini, 12), model)) AS model FROM g WHERE gini IS NOT NULL GROUP BY mes""")
def best_candidate(spark, sf_dir):
    table = M.auc_table(long_scores(scores(spark, sf_dir), MODELS), ["model", "mes"])
    return I.best_row(table.where(F.col("gini").isNotNull()), "gini", ["model"], ["mes"]).select("mes", "model")


@query("w16_holm", SCORES_SQL + f""",
{gini_sql('long', 'model, mes')}, pv AS (SELECT model, mes, round(1 - abs(gini), 9) AS p FROM g WHERE gini IS NOT NULL),
st AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY model) - row_number() OVER (PARTITION BY model ORDER BY p, mes) + 1) * p) AS s FROM pv)
SELECT model, mes, round(max(s) OVER (PARTITION BY model ORDER BY p, mes), 9) AS p_holm FROM st""")
def holm(spark, sf_dir):
    table = M.auc_table(long_scores(scores(spark, sf_dir), MODELS), ["model", "mes"])
    p = table.where(F.col("gini").isNotNull()).select(
        "model", "mes", F.round(1 - F.abs("gini"), 9).alias("p"))
    return rounded(I.holm(p, "p", ["model"], ["mes"]).select("model", "mes", "p_holm"))
