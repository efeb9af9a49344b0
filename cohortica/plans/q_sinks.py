"""Sinks written to the shared folder and read back, checked against the same rows in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from cohortica.operators import contracts as C
from cohortica.operators import metrics as M
from cohortica.plans.panel import (CUTS, PANEL_SQL, SCORE_MONTH, SCORES_SQL, gini_sql, long_scores,
                                   panel, scores, valid_scores)
from cohortica.plans.q_features import K, KEYS, rounded
from cohortica.plans.registry import query
from cohortica.session import ensure_checkpoint_dir
from cohortica.sources import readers as R
from cohortica.sources import sinks as S


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{name}-{uuid.uuid4().hex}"


@query("snk1_submission", SCORES_SQL + f"""
SELECT id_cliente, round(m1, 9) AS prediccion, row_number() OVER (ORDER BY id_cliente) - 1 AS row_ord FROM scores WHERE mes = {SCORE_MONTH}""")
def submission(spark, sf_dir):
    """SNK1, SNK3 and V8: checked, written in reference order, read back in that order, published over an earlier one."""
    df = scores(spark, sf_dir).where(F.col("mes") == SCORE_MONTH)
    indexed = R.source_row_index(df, ["id_cliente"])
    path = shared_folder(spark, "submission")
    for column in ("m2", "m1"):                      # the second replaces the first
        S.write_submission(indexed.select("row_ord", "id_cliente", F.col(column).alias("prediccion")),
                           indexed.select("row_ord", "id_cliente"), path)
    return rounded(R.read_in_order(spark, path, "id_cliente long, prediccion double"))


@query("src1_panel_csv", PANEL_SQL + f"SELECT {K}, objetivo, edad, ingresos, banda_riesgo, es_nuevo_cliente FROM panel")
def panel_csv(spark, sf_dir):
    """SRC1: the panel as CSV files with ``True``/``False`` literals, columns in another order, read back with types."""
    path = shared_folder(spark, "panel-csv")
    literal = lambda c: F.when(F.col(c).cast("boolean"), "True").otherwise("False").alias(c)
    panel(spark, sf_dir).select("banda_riesgo", literal("objetivo"), "mes", literal("es_nuevo_cliente"), "ingresos", "id_cliente",
                                "edad").write.option("header", True).csv(path)
    kinds = {"id_cliente": "int", "mes": "int", "objetivo": "boolean", "edad": "int", "ingresos": "float",
             "banda_riesgo": "string", "es_nuevo_cliente": "boolean"}
    schema = R.schema_from_dictionary([(name, name, kind) for name, kind in kinds.items()])
    return R.read_panel_csv(spark, path, schema).select(
        "id_cliente", F.col("mes").cast("int"), F.col("objetivo").cast("int"), F.col("edad").cast("int"), "ingresos",
        "banda_riesgo", "es_nuevo_cliente")


@query("snk2_feature_table", PANEL_SQL + f"SELECT {K}, edad, numero_productos FROM panel WHERE mes >= 200001")
def feature_table(spark, sf_dir):
    """SNK2 and SNK3: partitioned by period; the read prunes to the wanted periods."""
    path = shared_folder(spark, "features")
    S.write_features(panel(spark, sf_dir).select(*KEYS, "edad", "numero_productos"), path)
    return spark.read.parquet(path).where(F.col("mes") >= 200001).select(*KEYS, "edad", "numero_productos")


@query("snk4_fold_results", SCORES_SQL + f"SELECT 'r1' AS run, CAST(mes AS INT) AS fold, id_cliente, round(m1, 9) AS prediccion FROM valid")
def fold_results(spark, sf_dir):
    """SNK4 and SRC6: every fold is its own partition; a rerun replaces only that one."""
    path = shared_folder(spark, "folds")
    df = valid_scores(spark, sf_dir).select(*KEYS, F.col("m1").alias("prediccion")).persist()
    try:
        for _, valid in [CUTS[0], *CUTS]:  # the first fold is written twice
            S.write_fold(df.where(F.col("mes") == valid).drop("mes"), path, "r1", valid)
    finally:
        df.unpersist()
    schema = "id_cliente long, prediccion double, run string, fold int"
    return rounded(spark.read.schema(schema).parquet(path).select("run", "fold", "id_cliente", "prediccion"))


@query("snk6_metric_report", SCORES_SQL + f""",
{gini_sql('vlong', 'model, mes')}
SELECT model, mes, n_rows, events, round(gini, 9) AS gini FROM g""")
def metric_report(spark, sf_dir):
    path = shared_folder(spark, "report")
    table = M.auc_table(long_scores(valid_scores(spark, sf_dir), ["m1", "m2", "m3"]), ["model", "mes"])
    S.write_report(table.select("model", "mes", "n_rows", "events", "gini"), path)
    return rounded(spark.read.schema("model string, mes int, n_rows long, events long, gini double").json(path))


@query("v9_sample_parity", SCORES_SQL + f"""
SELECT CAST(0 AS BIGINT) AS missing_rows, CAST(0 AS BIGINT) AS extra_rows, CAST(0 AS BIGINT) AS id_mismatches, CAST(0 AS BIGINT) AS non_numeric,
  CAST(0 AS BIGINT) AS non_finite, count(*) FILTER (m2 < 0 OR m2 > 1) AS out_of_range FROM scores WHERE mes = {SCORE_MONTH}""")
def sample_parity(spark, sf_dir):
    """V9: a submission mirrors the sample table's ids and order."""
    df = scores(spark, sf_dir).where(F.col("mes") == SCORE_MONTH)
    sample = R.source_row_index(df.select("id_cliente", "m2"), ["id_cliente"])
    return C.submission_check(sample.select("row_ord", "id_cliente", F.col("m2").alias("prediccion")),
                              sample.select("row_ord", "id_cliente"))
