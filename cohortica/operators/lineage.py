"""Checksummed lineage as tables: fingerprints, manifests, verification, resumable folds."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortica.functions.features import known_category
from cohortica.functions.hashing import hash_int
from cohortica.operators.contracts import ContractViolation
from cohortica.sources.readers import file_records

MANIFEST_SCHEMA = "run string, section string, path string, bytes long, sha256 string"
STATE_SCHEMA = ("model string, fold int, status string, identity string, n_rows long, "
                "seconds double, error string, gini double")


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-free content hash of a table (L1, SNK2).

    Row hashes are summed exactly, so any row order and any partitioning agree and
    duplicate rows do not cancel out. Every value is preceded by its length, so no two
    different rows have the same text; two sums of 48-bit hashes make the content hash.
    """
    row = F.concat(*[_marked(c) for c in (columns or df.columns)])
    sums = [F.sum(hash_int(seed, row).cast("decimal(20,0)")).cast("string") for seed in (0, 1)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", *sums).alias("content_hash"))


def _marked(column: str) -> Column:
    """Length and text of a value, ``-`` for NULL: parts joined like this cannot be confused."""
    text = F.col(column).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def build_manifest(spark: SparkSession, run: str, sections: dict[str, str], pattern: str = "*") -> DataFrame:
    """File records of every section's folder (L2)."""
    out = None
    for section, path in sections.items():
        part = file_records(spark, path, pattern).select(
            F.lit(run).alias("run"), F.lit(section).alias("section"), "path", "bytes", "sha256")
        out = part if out is None else out.unionByName(part)
    return out


def run_record(spark: SparkSession, run: str, parameters: dict, metrics: dict, environment: dict,
               eligible: bool) -> DataFrame:
    """One row per run with its JSON parameters and metrics (L2, L4)."""
    values = [json.dumps(x, sort_keys=True) for x in (parameters, metrics, environment)]
    return spark.createDataFrame(
        [(run, *values, eligible)],
        "run string, parameters string, metrics string, environment string, eligible boolean")


def append_index(record: DataFrame, path: str) -> None:
    """Add a run to the index table; a run that is already there is an error (L4)."""
    spark = record.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        again = spark.read.schema(record.schema).parquet(path).join(record.select("run"), "run", "left_semi").select("run").limit(5).collect()
        if again:
            raise ContractViolation(f"runs already in the index: {sorted(r['run'] for r in again)}")
    record.write.mode("append").parquet(path)


def verify_files(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Manifest records against present files: missing, size or checksum mismatch, in that order (L3)."""
    now = actual.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    problem = (F.when(F.col("_sha").isNull(), "missing")
               .when(F.col("_bytes") != F.col("bytes"), "size mismatch")
               .when(F.col("_sha") != F.col("sha256"), "checksum mismatch").otherwise("ok"))
    return manifest.join(now, "path", "left").select(*manifest.columns, problem.alias("status"))


def top_name(spark: SparkSession, folder: str) -> Column:
    """File or folder directly under ``folder`` that holds ``path``: a table written by Spark is a folder of files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return F.split(F.substring("path", len(root.rstrip("/")) + 2, 1 << 20), "/")[0]


def worst_status() -> Column:
    """Aggregate over `verify_files` rows: the first of missing, size mismatch, checksum mismatch that occurs, else ``ok``."""
    seen = [F.max(F.when(F.col("status") == s, s)) for s in ("missing", "size mismatch", "checksum mismatch")]
    return F.coalesce(*seen, F.lit("ok"))


def require_intact(manifest: DataFrame, actual: DataFrame) -> None:
    bad = verify_files(manifest, actual).where(F.col("status") != "ok").limit(20).collect()
    if bad:
        raise ContractViolation(f"damaged artifacts: {[(r['status'], r['path']) for r in bad]}")


def identity_key(*parts: str | None) -> str:
    """Expression text of a cache key: SHA-256 over the parts."""
    from hashlib import sha256
    return sha256("".join("-" if p is None else f"{len(p)}:{p}" for p in parts).encode()).hexdigest()


def with_identity(df: DataFrame, columns: Sequence[str], out: str = "identity") -> DataFrame:
    """The same key for rows of a configuration table."""
    return df.withColumn(out, F.sha2(F.concat(*[_marked(c) for c in columns]), 256))


def pending_folds(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """Wanted (model, fold, identity) rows that no complete run covers."""
    done = state.where(F.col("status") == "complete").select("model", "fold", "identity")
    return wanted.join(done, ["model", "fold", "identity"], "left_anti")


def identity_conflicts(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """Complete folds recorded under another identity: resuming over them is an error."""
    done = state.where(F.col("status") == "complete").select(
        "model", "fold", F.col("identity").alias("_stored"))
    return wanted.join(done, ["model", "fold"]).where(F.col("identity") != F.col("_stored")).select(
        "model", "fold")


def resume(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """Folds still to run, after checking that stored ones belong to the same identity."""
    clash = identity_conflicts(wanted, state).collect()
    if clash:
        raise ContractViolation(f"stored folds have another identity: {[(r[0], r[1]) for r in clash]}")
    return pending_folds(wanted, state)


def resume_status(wanted: DataFrame, state: DataFrame, manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """What may be done with every wanted fold (L5): ``reuse``, ``run``, or what is wrong with the stored one.

    A stored fold is reused only when it is complete, has the wanted identity and number of rows,
    and every file the manifest lists for it is there with its size and checksum. ``manifest`` has
    (model, fold, path, bytes, sha256); a complete fold without a listed file is ``missing``.
    """
    done = state.where(F.col("status") == "complete").select(
        "model", "fold", F.col("identity").alias("_identity"), F.col("n_rows").alias("_rows"))
    worst = F.max(F.when(F.col("status") != "ok", F.col("status")))
    files = verify_files(manifest, actual).groupBy("model", "fold").agg(worst.alias("_bad"), F.count(F.lit(1)).alias("_files"))
    status = (F.when(F.col("_identity").isNull(), "run").when(F.col("_identity") != F.col("identity"), "other identity")
              .when(~F.col("_rows").eqNullSafe(F.col("n_rows")), "row count").when(F.col("_files").isNull(), "missing")
              .otherwise(F.coalesce("_bad", F.lit("reuse"))))
    return wanted.join(done, ["model", "fold"], "left").join(files, ["model", "fold"], "left").select(
        *wanted.columns, status.alias("status"))


def resume_verified(wanted: DataFrame, state: DataFrame, manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Folds still to run; an error when a stored one cannot be trusted."""
    status = resume_status(wanted, state, manifest, actual)
    bad = status.where(~F.col("status").isin("run", "reuse")).limit(20).collect()
    if bad:
        raise ContractViolation(f"stored folds cannot be reused: {[(r['model'], r['fold'], r['status']) for r in bad]}")
    return status.where(F.col("status") == "run").select(*wanted.columns)


def schema_record(df: DataFrame, features: Sequence[str], variant: str) -> DataFrame:
    """Column order and type of a feature variant."""
    types = dict(df.dtypes)
    return df.sparkSession.createDataFrame(
        [(variant, i, c, types[c]) for i, c in enumerate(features)],
        "variant string, position int, column string, type string")


def vocabulary_record(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Categories of every category column with their row counts."""
    long = df.select(*[known_category(c).alias(c) for c in categorical]).unpivot(
        [], list(categorical), "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def fold_status(state: DataFrame, expected: DataFrame) -> DataFrame:
    """Every expected (model, fold) with its state, ``not_started`` where none exists.

    A model without any state row is listed too, because the pairs come from ``expected``.
    """
    return expected.select("model", "fold").distinct().join(
        state, ["model", "fold"], "left").withColumn("status", F.coalesce("status", F.lit("not_started")))


def status_rollup(status: DataFrame) -> DataFrame:
    """Complete or incomplete per model, with rows and seconds."""
    return status.groupBy("model").agg(
        F.when(F.min((F.col("status") == "complete").cast("int")) == 1, "complete")
        .otherwise("incomplete").alias("status"),
        F.count(F.lit(1)).alias("n_folds"), F.sum("n_rows").alias("n_rows"),
        F.sum("seconds").alias("seconds"), F.avg("gini").alias("mean_gini"))
