"""Intermediate tables that are computed once and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from cohortica.session import ensure_checkpoint_dir


def stored(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Readers prune columns and filters; every reader sees the same rows, whatever is lost.
    With a folder for each value of ``by``, Spark knows the size of one value's rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
