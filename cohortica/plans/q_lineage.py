"""Lineage tables over the input files and the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortica.operators import lineage as L
from cohortica.operators import metrics as M
from cohortica.plans.panel import CUTS, PANEL_SQL, SCORES_SQL, gini_sql, long_scores, panel, valid_scores
from cohortica.plans.q_features import rounded
from cohortica.plans.q_splits import hash_int_sql
from cohortica.plans.registry import query
from cohortica.plans.q_sinks import shared_folder
from cohortica.sources.readers import file_records, read_table
from cohortica.spec import CATEGORICAL_COLUMNS


def marked_sql(*columns: str) -> str:
    """Length and text of each value, '-' for NULL, joined."""
    return " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("l1_table_fingerprint", f"""
WITH o AS (SELECT o_orderkey, nullif(o_custkey, 7) AS o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(15, 2)) AS o_totalprice,
  CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders), t AS (SELECT {marked_sql(*ORDER_COLUMNS)} AS row FROM o)
SELECT count(*) AS n_rows, CAST(sum(CAST({hash_int_sql(0, 't.row')} AS HUGEINT)) AS VARCHAR) || '-'
  || CAST(sum(CAST({hash_int_sql(1, 't.row')} AS HUGEINT)) AS VARCHAR) AS content_hash FROM t""")
def table_fingerprint(spark, sf_dir):
    """L1 over every column, with some NULLs."""
    orders = read_table(spark, sf_dir, "orders")
    return L.table_fingerprint(orders.select(
        "o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("o_custkey"), "o_orderstatus",
        F.col("o_totalprice").cast("decimal(15,2)").alias("o_totalprice"),
        F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority"))


def text_files(df, line, group, order, path):
    """One text file a value of ``group``: its lines in order."""
    rows = df.select(F.col(group).cast("string").alias(group), line.alias("value"), order)
    rows.repartition(group).sortWithinPartitions(group, order).drop(order).write.partitionBy(group).text(path)


def file_group(group):
    """Value of ``group`` in the path of a file."""
    return F.regexp_extract("path", f"/{group}=([^/]+)/", 1)


@query("l2_manifest", """
WITH l AS (SELECT c_mktsegment, c_custkey, c_custkey || '|' || c_name || chr(10) AS line FROM customer)
SELECT 'run-1' AS run, 'inputs' AS section, c_mktsegment AS segment, CAST(sum(strlen(line)) AS BIGINT) AS bytes,
  sha256(string_agg(line, '' ORDER BY c_custkey)) AS sha256 FROM l GROUP BY c_mktsegment""")
def manifest(spark, sf_dir):
    """SRC5 and L2: one text file a customer segment, listed with size and digest."""
    path = shared_folder(spark, "segments")
    customer = read_table(spark, sf_dir, "customer")
    text_files(customer, F.concat_ws("|", "c_custkey", "c_name"), "c_mktsegment", "c_custkey", path)
    return L.build_manifest(spark, "run-1", {"inputs": path}).where(F.col("path").endswith(".txt")).select(
        "run", "section", file_group("c_mktsegment").alias("segment"), "bytes", "sha256")


@query("l2_run_records", PANEL_SQL + """
SELECT 'run-' || band AS run, '{"band": "' || band || '", "folds": 3}' AS parameters, '{"rows": ' || count(*) || '}' AS metrics,
  '{"engine": "spark"}' AS environment, count(*) > 0 AS eligible FROM (SELECT banda_riesgo AS band FROM panel) GROUP BY band""")
def run_records(spark, sf_dir):
    """L2 and L4: parameters, metrics and environment of each run, appended to the index and read back."""
    path = shared_folder(spark, "index")
    rows = {r["banda_riesgo"]: r["count"] for r in panel(spark, sf_dir).groupBy("banda_riesgo").count().collect()}
    for band, n in sorted(rows.items()):
        L.append_index(L.run_record(spark, f"run-{band}", {"band": band, "folds": 3}, {"rows": n}, {"engine": "spark"}, n > 0), path)
    return spark.read.parquet(path)


TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
          "orders", "pages", "part", "region", "supplier"]


@query("l3_verify_files", "SELECT file, status FROM (VALUES " + ", ".join(
    "('part.parquet.gone', 'missing')" if t == "part" else f"('{t}.parquet', '" + {
        "nation": "size mismatch", "region": "checksum mismatch"}.get(t, "ok") + "')" for t in TABLES) + ") v(file, status)")
def verify_files(spark, sf_dir):
    """The input files against a manifest in which three records were altered; a table of many files has its worst status."""
    actual = file_records(spark, sf_dir, "*.parquet")
    name = L.top_name(spark, sf_dir)
    altered = L.build_manifest(spark, "run-1", {"inputs": sf_dir}, "*.parquet").select(
        "run", "section",
        F.when(name == "part.parquet", F.concat(name, F.lit(".gone"))).otherwise(name).alias("file"),
        F.when(name == "part.parquet", F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"),
        F.when(name == "nation.parquet", F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"),
        F.when(name == "region.parquet", F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    return L.verify_files(altered, actual).groupBy("file").agg(L.worst_status().alias("status"))


def wanted_and_state(spark, sf_dir):
    """One wanted fold per model and month of the panel; even months are complete."""
    base = panel(spark, sf_dir).groupBy("mes").agg(F.count(F.lit(1)).alias("n_rows"))
    models = F.explode(F.array(F.lit("gbt"), F.lit("logistic")))
    wanted = L.with_identity(base.select(models.alias("model"), F.col("mes").alias("fold"), "n_rows"),
                             ["model", "fold", "n_rows"])
    done = wanted.where((F.col("fold") % 2 == 0) | (F.col("model") == "gbt"))
    state = done.select("model", "fold", F.when((F.col("fold") % 7 == 0), "failed").otherwise("complete").alias("status"),
                        "identity", "n_rows", (F.col("n_rows") / 10).alias("seconds"),
                        F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("gini"))
    return wanted, state


STATE_SQL = PANEL_SQL + """,
base AS (SELECT mes AS fold, count(*) AS n_rows FROM panel GROUP BY 1),
wanted AS (SELECT model, fold, n_rows, sha256(length(model) || ':' || model || length(fold::VARCHAR) || ':' || fold || length(n_rows::VARCHAR) || ':' || n_rows) AS identity FROM base, (VALUES ('gbt'), ('logistic')) m(model)),
state AS (SELECT *, CASE WHEN fold % 7 = 0 THEN 'failed' ELSE 'complete' END AS status, n_rows / 10.0::DOUBLE AS seconds FROM wanted WHERE fold % 2 = 0 OR model = 'gbt')"""


@query("l5_pending_folds", STATE_SQL + """
SELECT model, fold, n_rows, identity FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.status = 'complete' AND s.model = w.model AND s.fold = w.fold AND s.identity = w.identity)""")
def pending_folds(spark, sf_dir):
    """L5 and L6."""
    return L.pending_folds(*wanted_and_state(spark, sf_dir))


@query("l5_verified_resume", STATE_SQL + """
SELECT w.model, w.fold, CASE WHEN s.status IS NULL OR s.status <> 'complete' THEN 'run' WHEN w.fold % 11 = 0 THEN 'other identity' WHEN w.fold % 13 = 0 THEN 'row count'
  WHEN w.model = 'logistic' THEN 'missing' WHEN w.fold % 4 = 1 THEN 'missing' WHEN w.fold % 4 = 2 THEN 'size mismatch' WHEN w.fold % 4 = 3 THEN 'checksum mismatch'
  ELSE 'reuse' END AS status FROM wanted w LEFT JOIN state s USING (model, fold)""")
def verified_resume(spark, sf_dir):
    """A file a month is the artifact of one model; some records, identities and row counts were altered."""
    path = shared_folder(spark, "artifacts")
    text_files(panel(spark, sf_dir), F.col("id_cliente").cast("string"), "mes", "id_cliente", path)
    actual = file_records(spark, path, "*.txt")
    kind = file_group("mes").cast("int") % 4
    listed = actual.select(
        F.lit("gbt").alias("model"), file_group("mes").cast("int").alias("fold"),
        F.when(kind == 1, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"),
        F.when(kind == 2, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"),
        F.when(kind == 3, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    wanted, state = wanted_and_state(spark, sf_dir)
    state = state.withColumn("identity", F.when(F.col("fold") % 11 == 0, F.lit("other")).otherwise(F.col("identity"))).withColumn(
        "n_rows", F.when(F.col("fold") % 13 == 0, F.col("n_rows") + 1).otherwise(F.col("n_rows")))
    return L.resume_status(wanted, state, listed, actual).select("model", "fold", "status")


@query("l8_fold_status", STATE_SQL + """
SELECT model, CASE WHEN min((coalesce(status, 'none') = 'complete')::INT) = 1 THEN 'complete' ELSE 'incomplete' END AS status, count(*) AS n_folds,
  CAST(sum(s.n_rows) AS BIGINT) AS n_rows, round(sum(seconds), 6) AS seconds FROM wanted w LEFT JOIN state s USING (model, fold) GROUP BY model""")
def fold_status(spark, sf_dir):
    wanted, state = wanted_and_state(spark, sf_dir)
    return L.status_rollup(L.fold_status(state, wanted)).select(
        "model", "status", "n_folds", "n_rows", F.round("seconds", 6).alias("seconds"))


@query("l7_schema_record", PANEL_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n_rows FROM panel GROUP BY {c}"
    for c in CATEGORICAL_COLUMNS))
def schema_record(spark, sf_dir):
    return L.vocabulary_record(panel(spark, sf_dir), CATEGORICAL_COLUMNS)


@query("l4_run_index", SCORES_SQL + f""",
{gini_sql('vlong', 'model, mes')}
SELECT 'run-' || model AS run, round(avg(gini), 9) AS mean_gini, avg(gini) > 0 AS eligible FROM g GROUP BY model""")
def run_index(spark, sf_dir):
    """One row per run with its headline metric and eligibility (L4, SNK6)."""
    table = M.auc_table(long_scores(valid_scores(spark, sf_dir), ["m1", "m2", "m3"]), ["model", "mes"])
    mean = M.monthly_summary(table, ["model"])
    return rounded(mean.select(F.concat(F.lit("run-"), F.col("model")).alias("run"), "mean_gini",
                               (F.col("mean_gini") > 0).alias("eligible")))
