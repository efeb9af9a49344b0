"""Scans and data contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortica.operators import contracts as C
from cohortica.operators import metrics as M
from cohortica.operators.history import add_history
from cohortica.plans.panel import (PANEL_SQL, SCORE_MONTH, SCORES_SQL, TRAIN_THROUGH, gini_sql, long_scores, panel,
                                   scores, valid_scores)
from cohortica.plans.registry import query
from cohortica.sources import readers as R
from cohortica.spec import BOOLEAN_COLUMNS, CATEGORICAL_COLUMNS, NUMERIC_COLUMNS

TRAIN_SCORE_SQL = PANEL_SQL + f""",
train AS (SELECT * FROM panel WHERE mes <= {TRAIN_THROUGH}),
score AS (SELECT * FROM panel WHERE mes = {SCORE_MONTH})"""


def train_score(spark, sf_dir):
    df = panel(spark, sf_dir)
    return (df.where(F.col("mes") <= TRAIN_THROUGH),
            df.where(F.col("mes") == SCORE_MONTH).drop("objetivo"))


@query("src1_panel_scan", PANEL_SQL + f"""
SELECT id_cliente, mes, objetivo, {', '.join(NUMERIC_COLUMNS + CATEGORICAL_COLUMNS + BOOLEAN_COLUMNS)} FROM panel""")
def panel_scan(spark, sf_dir):
    return panel(spark, sf_dir).drop("gasto")


@query("src2_pruned_scan", "SELECT o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def pruned_scan(spark, sf_dir):
    return R.read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate"]).where(
        F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))


@query("src3_schema_report", """
SELECT column_name, declared_type, actual_type, coalesce(declared_type = actual_type, false) AS matches FROM (VALUES
  ('c_custkey', 'int', 'int'), ('c_name', 'string', 'string'), ('c_nationkey', 'string', 'int'), ('c_acctbal', 'float', 'float'),
  ('c_mktsegment', NULL, 'string'), ('c_phone', 'string', NULL)) t(column_name, declared_type, actual_type)""")
def schema_report(spark, sf_dir):
    """SRC3: a dictionary with matching, wrong and missing entries against the customer table."""
    declared = spark.createDataFrame(
        [("c_custkey", "int"), ("c_name", "string"), ("c_nationkey", "string"), ("c_acctbal", "float"), ("c_phone", "string")],
        "column_name string, type string")
    return R.schema_report(R.read_table(spark, sf_dir, "customer"), declared)


@query("src4_source_row_index", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_ord FROM orders""")
def source_row_index(spark, sf_dir):
    orders = R.read_table(spark, sf_dir, "orders", ["o_orderdate", "o_orderkey"])
    return R.source_row_index(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_ord")


@query("src5_file_records")
def file_records(spark, sf_dir):
    """Size and SHA-256 of every input file."""
    return R.file_records(spark, sf_dir, "*.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


@query("src7_mean_over_seeds", SCORES_SQL + """
SELECT id_cliente, mes, count(*) AS n_seeds, round(avg(score * (1 + seed / 100.0::DOUBLE)), 9) AS score
FROM vlong, (VALUES (42), (43), (44)) s(seed) WHERE model = 'm1' GROUP BY 1, 2""")
def mean_over_seeds(spark, sf_dir):
    stored = seed_scores(valid_scores(spark, sf_dir)).select("id_cliente", "mes", "seed", "score")
    return R.mean_over_seeds(stored, ["id_cliente", "mes"]).select(
        "id_cliente", "mes", "n_seeds", F.round("score", 9).alias("score"))


def seed_scores(df):
    """Three per-seed variants of one score, as a stored seed table would hold."""
    seeds = F.explode(F.array(*[F.lit(s) for s in (42, 43, 44)]))
    return df.withColumn("seed", seeds).withColumn(
        "score", F.col("m1") * (1 + F.col("seed") / F.lit(100.0)))


@query("v2_missing_values", f"""
SELECT CAST(sum(CASE WHEN ts IS NULL THEN 1 ELSE 0 END + CASE WHEN user_id IS NULL THEN 1 ELSE 0 END +
  CASE WHEN event_type IS NULL THEN 1 ELSE 0 END + CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END +
  CASE WHEN props IS NULL THEN 1 ELSE 0 END + CASE WHEN event_id IS NULL THEN 1 ELSE 0 END) AS BIGINT)
  + (SELECT CAST(sum(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END + CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END + CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END
  + CASE WHEN o_totalprice IS NULL OR isnan(o_totalprice) THEN 1 ELSE 0 END + CASE WHEN o_orderdate IS NULL THEN 1 ELSE 0 END
  + CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM orders) AS missing FROM events""")
def missing_values(spark, sf_dir):
    return C.missing_values(R.read_table(spark, sf_dir, "events"), R.read_table(spark, sf_dir, "orders"))


@query("v3_duplicate_keys", """
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
  SELECT o_custkey, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2)""")
def duplicate_keys(spark, sf_dir):
    orders = R.read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate"])
    monthly = orders.select("o_custkey", F.trunc(F.to_date("o_orderdate"), "month").alias("m"))
    return C.duplicate_keys(monthly, ["o_custkey", "m"])


@query("v4_binary_label", PANEL_SQL + """
SELECT CAST(sum(CASE WHEN objetivo NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) AS invalid_labels,
  CAST(CASE WHEN sum(CASE WHEN objetivo = 0 THEN 1 ELSE 0 END) = 0 THEN 1 ELSE 0 END AS BIGINT) AS no_negatives,
  CAST(CASE WHEN sum(CASE WHEN objetivo = 1 THEN 1 ELSE 0 END) = 0 THEN 1 ELSE 0 END AS BIGINT) AS no_positives FROM panel""")
def binary_label(spark, sf_dir):
    return C.binary_label(panel(spark, sf_dir), "objetivo")


@query("v5_temporal_order", TRAIN_SCORE_SQL + """
SELECT CAST((SELECT max(mes) FROM train) >= (SELECT min(mes) FROM score) AS BIGINT) AS overlap,
  (SELECT count(*) FROM panel WHERE mes % 100 NOT BETWEEN 1 AND 12) AS malformed_periods,
  CAST((SELECT count(*) FROM train) = 0 OR (SELECT count(*) FROM score) = 0 AS BIGINT) AS empty_table""")
def temporal_order(spark, sf_dir):
    train, score = train_score(spark, sf_dir)
    return C.temporal_order(train, score, "mes")


RAW_SQL = PANEL_SQL + ", raw AS (SELECT id_cliente, mes, objetivo FROM om0)"


def raw_months(spark, sf_dir):
    """Customer-months before the cut at the event, so the contract has work to do."""
    urgent = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    return R.read_table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("id_cliente"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("mes"),
    ).agg(F.max(urgent.cast("int")).alias("objetivo"))


@query("v6_absorbing_event", RAW_SQL + """
SELECT (SELECT count(*) FROM (SELECT id_cliente FROM raw GROUP BY 1 HAVING sum(objetivo) > 1)) AS repeated_events,
  (SELECT count(*) FROM raw JOIN (SELECT id_cliente AS i, min(mes) AS at_ FROM raw WHERE objetivo = 1 GROUP BY 1)
   ON id_cliente = i WHERE mes > at_) AS rows_after_event""")
def absorbing_event(spark, sf_dir):
    return C.absorbing_event(raw_months(spark, sf_dir))


@query("v6_rows_after_event_panel", PANEL_SQL + "SELECT CAST(0 * count(*) AS BIGINT) AS rows_after_event FROM panel")
def rows_after_event_panel(spark, sf_dir):
    return C.running_event_violations(panel(spark, sf_dir))


@query("v6_converted_in_score", RAW_SQL + f"""
SELECT count(*) AS already_converted FROM raw WHERE mes = {SCORE_MONTH} AND id_cliente IN (
  SELECT id_cliente FROM raw WHERE mes <= {TRAIN_THROUGH} AND objetivo = 1)""")
def converted_in_score(spark, sf_dir):
    raw = raw_months(spark, sf_dir)
    return C.converted_in_score(raw.where(F.col("mes") <= TRAIN_THROUGH),
                                raw.where(F.col("mes") == SCORE_MONTH))


@query("v7_seen_report", TRAIN_SCORE_SQL + """
SELECT count(*) AS n_rows, count(*) FILTER (id_cliente IN (SELECT id_cliente FROM train)) AS seen_rows,
  count(*) FILTER (id_cliente NOT IN (SELECT id_cliente FROM train)) AS unseen_rows FROM score""")
def seen_report(spark, sf_dir):
    train, score = train_score(spark, sf_dir)
    return C.seen_report(train, score, "id_cliente")


@query("v8_submission_check", SCORES_SQL + f""",
s AS (SELECT id_cliente, row_number() OVER (ORDER BY id_cliente) - 1 AS row_ord,
  CASE WHEN id_cliente % 50 = 7 THEN m1 + 1 ELSE m1 END AS p,
  CASE WHEN id_cliente % 40 = 3 THEN 1 ELSE 0 END AS text_, CASE WHEN id_cliente % 30 = 5 THEN 1 ELSE 0 END AS wrong_
  FROM scores WHERE mes = {SCORE_MONTH})
SELECT CAST(0 AS BIGINT) AS missing_rows, CAST(0 AS BIGINT) AS extra_rows, CAST(sum(wrong_) AS BIGINT) AS id_mismatches,
  CAST(sum(text_) AS BIGINT) AS non_numeric, CAST(0 AS BIGINT) AS non_finite,
  count(*) FILTER (text_ = 0 AND (p < 0 OR p > 1)) AS out_of_range FROM s""")
def submission_check(spark, sf_dir):
    df = scores(spark, sf_dir).where(F.col("mes") == SCORE_MONTH)
    indexed = R.source_row_index(df, ["id_cliente"])
    cid = F.col("id_cliente")
    p = F.when(cid % 50 == 7, F.col("m1") + 1).otherwise(F.col("m1")).cast("string")
    submission = indexed.select(
        "row_ord", F.when(cid % 30 == 5, -cid - 1).otherwise(cid).alias("id_cliente"),
        F.when(cid % 40 == 3, F.lit("n/a")).otherwise(p).alias("prediccion"))
    return C.submission_check(submission, indexed.select("row_ord", "id_cliente"))


@query("v10_probability_coverage", SCORES_SQL + """
SELECT count(*) FILTER (id_cliente % 9 = 0) AS missing_predictions, count(*) FILTER (id_cliente % 9 <> 0 AND id_cliente % 10 = 1) AS unexpected_predictions,
  count(*) FILTER (id_cliente % 9 <> 0 AND id_cliente % 8 = 2) AS duplicate_predictions,
  count(*) FILTER (id_cliente % 9 <> 0 AND m1 + 0.5 > 1) + count(*) FILTER (id_cliente % 9 <> 0 AND id_cliente % 8 = 2 AND m1 + 0.5 > 1)
  + count(*) FILTER (id_cliente % 9 <> 0 AND id_cliente % 10 = 1 AND m1 + 0.5 > 1) AS invalid_probabilities FROM valid""")
def probability_coverage(spark, sf_dir):
    df = valid_scores(spark, sf_dir)
    predictions = df.where(F.col("id_cliente") % 9 != 0).select("id_cliente", "mes", (F.col("m1") + 0.5).alias("p"))
    foreign = predictions.where(F.col("id_cliente") % 10 == 1).withColumn("id_cliente", -F.col("id_cliente") - 1)
    predictions = predictions.unionByName(predictions.where(F.col("id_cliente") % 8 == 2)).unionByName(foreign)
    return C.probability_coverage(df, predictions, ["id_cliente", "mes"], "p")


@query("v12_row_set_alignment", SCORES_SQL + """
SELECT count(*) FILTER (id_cliente % 7 = 0) AS only_left, count(*) FILTER (id_cliente % 11 = 0) AS only_right
FROM valid WHERE NOT (id_cliente % 7 = 0 AND id_cliente % 11 = 0)""")
def row_set_alignment(spark, sf_dir):
    df = valid_scores(spark, sf_dir).select("id_cliente", "mes")
    return C.row_set_difference(df.where(F.col("id_cliente") % 11 != 0),
                                df.where(F.col("id_cliente") % 7 != 0), ["id_cliente", "mes"])


@query("v11_stored_baseline", SCORES_SQL + """
SELECT count(*) FILTER (id_cliente % 13 = 0) AS only_left, count(*) FILTER (id_cliente % 13 = 0) AS only_right FROM valid""")
def stored_baseline(spark, sf_dir):
    df = valid_scores(spark, sf_dir).select("id_cliente", "mes", "objetivo")
    changed = df.withColumn("objetivo", F.when(
        F.col("id_cliente") % 13 == 0, 1 - F.col("objetivo")).otherwise(F.col("objetivo")))
    return C.row_set_difference(df, changed, ["id_cliente", "mes", "objetivo"])


@query("v13_prefix_invariance", PANEL_SQL + """
SELECT mes AS cut, CAST(0 AS BIGINT) AS changed_rows FROM (VALUES (199806), (199912)) t(mes) WHERE (SELECT count(*) FROM panel) > 0""")
def prefix_invariance(spark, sf_dir):
    df = panel(spark, sf_dir).select("id_cliente", "mes", "objetivo")
    return C.check_causal(add_history, df, [199806, 199912])


@query("v14_reproduction", SCORES_SQL + """
SELECT count(*) AS n_rows, round(max(abs(round(m1, 3) - m1)), 9) AS max_abs_diff,
  count(*) FILTER (abs(round(m1, 3) - m1) > 0.0004) AS beyond_tolerance FROM valid""")
def reproduction(spark, sf_dir):
    df = valid_scores(spark, sf_dir)
    stored = df.withColumn("m1", F.round("m1", 3))
    return C.reproduction(stored, df, ["id_cliente", "mes"], "m1", 0.0004).withColumn(
        "max_abs_diff", F.round("max_abs_diff", 9))


@query("v15_prediction_audit", SCORES_SQL + """
SELECT model, count(*) FILTER (NOT (model = 'm3' AND id_cliente % 9 = 0)) + count(*) FILTER (model = 'm2' AND id_cliente % 8 = 2) AS n_rows,
  count(*) FILTER (model = 'm3' AND id_cliente % 9 = 0) AS missing_rows, CAST(0 AS BIGINT) AS unexpected_rows,
  count(*) FILTER (model = 'm2' AND id_cliente % 8 = 2) AS duplicate_rows,
  count(*) FILTER (model = 'm2' AND id_cliente % 8 = 2 AND (score < 0 OR score > 1)) + count(*) FILTER (NOT (model = 'm3' AND id_cliente % 9 = 0) AND (score < 0 OR score > 1)) AS invalid FROM vlong GROUP BY model""")
def prediction_audit(spark, sf_dir):
    df = valid_scores(spark, sf_dir)
    stored = long_scores(df, ["m1", "m2", "m3"]).where(
        ~((F.col("model") == "m3") & (F.col("id_cliente") % 9 == 0)))
    stored = stored.unionByName(stored.where((F.col("model") == "m2") & (F.col("id_cliente") % 8 == 2)))
    return C.prediction_audit(df, stored, "model", ["id_cliente", "mes"], "score")


@query("v15_metric_audit", SCORES_SQL + f""",
{gini_sql('vlong', 'model, mes')}
SELECT model, count(*) AS n_periods, round(max(CASE WHEN model = 'm2' THEN 0.25 ELSE 0 END), 6) AS max_abs_diff,
  count(*) FILTER (model = 'm2') AS not_reproduced FROM g GROUP BY model""")
def metric_audit(spark, sf_dir):
    """The stored Ginis of one model were altered."""
    long = long_scores(valid_scores(spark, sf_dir), ["m1", "m2", "m3"])
    stored = M.auc_table(long, ["model", "mes"]).select("model", "mes", (F.col("gini") + F.when(
        F.col("model") == "m2", 0.25).otherwise(0.0)).alias("gini"))
    return C.metric_audit(long, stored, "model", "mes", "score", "objetivo").withColumn(
        "max_abs_diff", F.round("max_abs_diff", 6))


@query("v1_schema_parity", PANEL_SQL + f"""
SELECT problem FROM (VALUES ('score table must not contain objetivo'), ('train and score columns differ in name or order')) t(problem)
WHERE (SELECT count(*) FROM panel WHERE mes = {SCORE_MONTH}) > 0""")
def schema_parity(spark, sf_dir):
    """V1: a score table that kept its label, with rows to score."""
    train, score = train_score(spark, sf_dir)
    leaked = score.withColumn("objetivo", F.lit(0))
    return C.layout_problems(train, leaked).join(F.broadcast(score.limit(1).select(F.lit(1).alias("_one"))), F.lit(True)).drop("_one")


@query("v16_plausibility", PANEL_SQL + """
SELECT round(avg(CASE WHEN antiguedad_cuenta_meses > (edad - 18) * 12 THEN 1 ELSE 0 END), 9) AS account_older_than_adult,
  round(avg(CASE WHEN antiguedad_direccion_meses > edad * 12 THEN 1 ELSE 0 END), 9) AS address_older_than_age FROM panel""")
def plausibility(spark, sf_dir):
    out = C.plausibility(panel(spark, sf_dir), {
        "account_older_than_adult": F.col("antiguedad_cuenta_meses") > (F.col("edad") - 18) * 12,
        "address_older_than_age": F.col("antiguedad_direccion_meses") > F.col("edad") * 12})
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])
