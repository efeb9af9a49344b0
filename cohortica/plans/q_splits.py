"""Temporal splits, hash folds, sampling and perturbation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortica.operators import metrics as M
from cohortica.operators import splits as S
from cohortica.plans.panel import CUTS, PANEL_SQL, SCORES_SQL, panel, scores, valid_scores
from cohortica.plans.q_features import K, KEYS, rounded
from cohortica.plans.registry import query
from cohortica.plans.panel import gini_sql


def hash_sql(seed: int, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"md5({text})"


def hash_int_sql(seed: int, *parts: str) -> str:
    return f"CAST('0x' || substr({hash_sql(seed, *parts)}, 1, 12) AS BIGINT)"


def uniform_sql(seed: int, *parts: str) -> str:
    return f"({hash_int_sql(seed, *parts)} / {float(2 ** 48)!r}::DOUBLE)"


@query("s1_outer_holdout", PANEL_SQL + f"""
SELECT {K}, CASE WHEN dense_rank() OVER (ORDER BY mes DESC) <= 2 THEN 'valid' ELSE 'train' END AS role FROM panel""")
def outer_holdout(spark, sf_dir):
    return S.outer_holdout(panel(spark, sf_dir).select(*KEYS))


@query("s2_inner_folds", PANEL_SQL + """,
m AS (SELECT mes, row_number() OVER (ORDER BY mes DESC) AS r FROM (SELECT DISTINCT mes FROM panel WHERE mes <= 199908))
SELECT CAST(m.mes AS INT) AS fold, CASE WHEN panel.mes = m.mes THEN 'valid' ELSE 'train' END AS role, count(*) AS n_rows, CAST(sum(objetivo) AS BIGINT) AS events
FROM panel JOIN m ON r <= 4 AND panel.mes <= m.mes GROUP BY 1, 2""")
def inner_folds(spark, sf_dir):
    return S.fold_counts(S.inner_folds(panel(spark, sf_dir).select(*KEYS, "objetivo"), end=199908), "objetivo")


def folds_sql(extra: str = "true") -> str:
    return PANEL_SQL + ", f AS (" + " UNION ALL ".join(
        f"SELECT CAST({v} AS INT) AS fold, CASE WHEN mes = {v} THEN 'valid' ELSE 'train' END AS role, * FROM panel WHERE mes = {v} OR (mes <= {t} AND {extra.format(t=t)})"
        for t, v in CUTS) + ")"


@query("s3_rolling_cuts", folds_sql() + f"SELECT fold, role, {K} FROM f")
def rolling_cuts(spark, sf_dir):
    """S3 and S6."""
    return S.assign_folds(panel(spark, sf_dir).select(*KEYS), CUTS)


@query("s4_frozen_split", PANEL_SQL + """
SELECT CAST(199902 AS INT) AS fold, CASE WHEN mes = 199902 THEN 'valid' ELSE 'train' END AS role, count(*) AS n_rows FROM panel WHERE mes <= 199812 OR mes = 199902 GROUP BY 1, 2
UNION ALL SELECT CAST(199903 AS INT), CASE WHEN mes = 199903 THEN 'valid' ELSE 'train' END, count(*) FROM panel WHERE mes <= 199812 OR mes = 199903 GROUP BY 1, 2""")
def frozen_split(spark, sf_dir):
    return S.fold_counts(S.assign_folds(panel(spark, sf_dir).select(*KEYS), [(199812, 199902), (199812, 199903)]))


@query("s5_entity_holdout", PANEL_SQL + f""",
h AS (SELECT *, CAST('0x' || substr(sha256(CAST(id_cliente AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0 AS held FROM panel)
SELECT {K}, CASE WHEN held THEN 'valid' ELSE 'train' END AS role FROM h WHERE (held AND mes = 199901) OR (NOT held AND mes < 199901)""")
def entity_holdout(spark, sf_dir):
    return S.entity_holdout(panel(spark, sf_dir).select(*KEYS), 199901)


@query("s7_sliding_window", folds_sql("ord > ({t} // 100) * 12 + {t} % 100 - 1 - 3") + "SELECT fold, role, count(*) AS n_rows FROM f GROUP BY 1, 2")
def sliding_window(spark, sf_dir):
    return S.fold_counts(S.assign_folds(panel(spark, sf_dir).select(*KEYS), CUTS, window=3))


@query("s8_hash_folds", PANEL_SQL + f"""
SELECT {K}, CAST({hash_int_sql(7, 'id_cliente', 'mes')} % 5 AS INT) AS row_fold, CAST({hash_int_sql(7, 'id_cliente')} % 5 AS INT) AS entity_fold FROM panel""")
def hash_folds(spark, sf_dir):
    rows = S.hash_folds(panel(spark, sf_dir).select(*KEYS), 5, KEYS, 7).withColumnRenamed("fold", "row_fold")
    return S.hash_folds(rows, 5, ["id_cliente"], 7).withColumnRenamed("fold", "entity_fold")


SAMPLE = 1000


def sample_sql(weight: str) -> str:
    """Quotas by largest remainder, the smallest hashes of each month, then the smallest of the rest."""
    return PANEL_SQL + f""",
tr AS (SELECT *, {hash_sql(42, 'id_cliente', 'mes')} AS u, row_number() OVER (PARTITION BY mes ORDER BY {hash_sql(42, 'id_cliente', 'mes')}) AS pos FROM panel),
sz AS (SELECT mes, count(*) AS n, row_number() OVER (ORDER BY mes) - 1 AS place FROM tr GROUP BY 1),
sh AS (SELECT *, w / sum(w) OVER () * {SAMPLE} AS share FROM (SELECT *, {weight} AS w FROM sz)),
wh AS (SELECT *, floor(share) AS whole, row_number() OVER (ORDER BY floor(share) - share, mes) AS r, {SAMPLE} - sum(floor(share)) OVER () AS open FROM sh),
q AS (SELECT mes, least(whole + CASE WHEN r <= open THEN 1 ELSE 0 END, n) AS quota FROM wh),
r AS (SELECT tr.*, row_number() OVER (ORDER BY CASE WHEN pos > quota THEN 1 ELSE 0 END, u) AS fin FROM tr JOIN q USING (mes))
SELECT {K} FROM r WHERE fin <= {SAMPLE}"""


@query("s9_stratified_sample", sample_sql("1.0::DOUBLE"))
def stratified_sample(spark, sf_dir):
    return S.stratified_sample(panel(spark, sf_dir).select(*KEYS), SAMPLE, "balanced-by-month", 42)


@query("s9_recency_sample", sample_sql("1.0::DOUBLE + place / greatest((SELECT count(*) FROM sz) - 1, 1)::DOUBLE"))
def recency_sample(spark, sf_dir):
    return S.stratified_sample(panel(spark, sf_dir).select(*KEYS), SAMPLE, "recency-aware", 42)


@query("s9_uniform_sample", PANEL_SQL + f"""
SELECT {K} FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql(42, 'id_cliente', 'mes')}) AS r FROM panel) WHERE r <= 500""")
def uniform_sample(spark, sf_dir):
    return S.stratified_sample(panel(spark, sf_dir).select(*KEYS), 500, "uniform", 42)


@query("s10_entity_subsample", PANEL_SQL + f"SELECT {K} FROM panel WHERE {uniform_sql(11, 'id_cliente')} < 0.25")
def entity_subsample(spark, sf_dir):
    return S.entity_subsample(panel(spark, sf_dir).select(*KEYS), 0.25, 11)


@query("s11_noise_injection", PANEL_SQL + f"""
SELECT {K}, CAST(d AS INT) AS draw, CAST(1 + {hash_int_sql(3, 'd', 'id_cliente', 'mes')} % 364 AS INT) AS dias_ultima_interaccion
FROM panel, generate_series(0, 4) g(d) WHERE mes IN (199901, 199902, 199903)""")
def noise_injection(spark, sf_dir):
    df = panel(spark, sf_dir).where(F.col("mes").isin([199901, 199902, 199903]))
    return S.inject_noise(df.select(*KEYS, "dias_ultima_interaccion"), "dias_ultima_interaccion", 1, 364, 5, 3)


@query("s12_permute_column", PANEL_SQL + f"""
SELECT a.id_cliente, a.mes, b.v AS edad FROM (SELECT {K}, row_number() OVER (PARTITION BY mes ORDER BY id_cliente) AS p FROM panel) a
JOIN (SELECT mes, edad AS v, row_number() OVER (PARTITION BY mes ORDER BY {hash_sql(5, 'id_cliente', 'mes')}) AS p FROM panel) b ON a.mes = b.mes AND a.p = b.p""")
def permute_column(spark, sf_dir):
    return S.permute_within_period(panel(spark, sf_dir).select(*KEYS, "edad"), "edad", 5)


@query("s13_label_redraw_ceiling", SCORES_SQL + f""",
d AS (SELECT CAST(r AS INT) AS replicate, m1 AS score, CASE WHEN {uniform_sql(9, 'r', 'id_cliente', 'mes')} < m1 THEN 1 ELSE 0 END AS objetivo
  FROM valid, generate_series(0, 199) g(r)),
{gini_sql('d', 'replicate')}
SELECT count(*) AS n_periods, round(avg(gini), 9) AS mean_gini, round(stddev_pop(gini), 9) AS std_gini FROM g""")
def label_redraw_ceiling(spark, sf_dir):
    drawn = S.redraw_labels(valid_scores(spark, sf_dir), "m1", 200, 9)
    return rounded(M.monthly_summary(M.auc_table(drawn, ["replicate"], "m1")))
