"""Table sinks: ordered submissions, feature tables, fold results, reports.

Writing goes through Spark's commit protocol, so a reader never sees half a
table and a lost executor only repeats its own files. Whole tables are written
beside the old one, checked, and swapped in.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortica.operators.contracts import enforce, submission_check
from cohortica.sources.readers import read_in_order
from cohortica.spec import DEFAULT, PanelSpec


def publish(spark: SparkSession, path: str, write: Callable[[str], None], check: Callable[[str], None] | None = None) -> None:
    """Replace the table at ``path`` as one step (SNK3).

    ``write`` fills a folder beside it and ``check`` may refuse what it reads there; only then
    the folders change names, and the old table goes. When anything fails the old table is
    where it was. Stores without renames (object stores) copy instead; there use a table format.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    staged, old = (f"{path.rstrip('/')}.{kind}-{mark}" for kind in ("staged", "old"))
    try:
        write(staged)
        if check:
            check(staged)
        replaces = fs.exists(target)
        if replaces and not fs.rename(target, hadoop(old)):
            raise OSError(f"{path} cannot be moved aside")
        if not fs.rename(hadoop(staged), target):
            if replaces:
                fs.rename(hadoop(old), target)
            raise OSError(f"{path} cannot be replaced")
    except BaseException:
        fs.delete(hadoop(staged), True)
        raise
    if replaces:
        fs.delete(hadoop(old), True)


def write_submission(submission: DataFrame, reference: DataFrame, path: str, row_ord: str = "row_ord",
                     files: int | None = None, spec: PanelSpec = DEFAULT) -> None:
    """Checked ``entity, score`` CSV in the reference row order (SNK1).

    The rows are range-partitioned by ``row_ord`` and sorted inside each file, so
    the files in name order are the contract order and no task holds the whole
    table. ``files=1`` gives the single small file a portal expects. What was written is read
    back and held against the reference, order included, before it replaces an earlier file.
    """
    enforce(submission_check(submission, reference, row_ord, spec))
    spark = submission.sparkSession
    by = [F.col(row_ord)]
    ranged = (submission.repartitionByRange(files, *by) if files
              else submission.repartitionByRange(*by))
    ordered = ranged.sortWithinPartitions(row_ord).select(spec.entity, spec.score)
    types = dict(submission.dtypes)
    schema = f"`{spec.entity}` {types[spec.entity]}, `{spec.score}` double"

    def check(staged: str) -> None:
        enforce(submission_check(read_in_order(spark, staged, schema, row_ord), reference, row_ord, spec))

    publish(spark, path, lambda staged: ordered.write.option("header", True).csv(staged), check)


def write_features(df: DataFrame, path: str, period: str = "mes") -> None:
    """Parquet partitioned by period; only the periods present are replaced (SNK2, SNK3).

    Rows are rebalanced by period: a small period is one file, a large one as many as its size asks for.
    """
    (df.hint("rebalance", F.col(period))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path))


def write_fold(df: DataFrame, path: str, run: str, fold: int) -> None:
    """Persist one finished fold; rerunning a fold replaces only its own partition (SNK4)."""
    (df.withColumn("run", F.lit(run)).withColumn("fold", F.lit(fold))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run", "fold").parquet(path))


def wide_oof(long: DataFrame, models: Sequence[str], digits: int = 7, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row per key with a rounded score column per model (SNK5)."""
    return long.groupBy(*spec.keys, spec.label).pivot("model", list(models)).agg(
        F.first(F.round("score", digits)))


def write_report(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON lines (SNK6)."""
    publish(metrics.sparkSession, path, metrics.write.json)
