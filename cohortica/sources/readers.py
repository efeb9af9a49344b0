"""Scans with fixed schemas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cohortica.spec import (BOOLEAN_COLUMNS, CATEGORICAL_COLUMNS, DEFAULT, NUMERIC_COLUMNS,
                            PanelSpec)

# Type names of the column dictionary.
DICTIONARY_TYPES = {
    "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(),
}
# Column types of the star-schema test tables. Reading with a known
# schema saves the inference job that opens the files first.
TABLE_SCHEMAS = {
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
               "props string"),
}
FRACTIONAL_COLUMNS = {
    "ingresos", "ratio_deuda_ingresos", "saldo_promedio", "distancia_sucursal_km"}


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table by name; a column list prunes the scan (SRC2)."""
    reader = spark.read.schema(TABLE_SCHEMAS[name]) if name in TABLE_SCHEMAS else spark.read
    df = reader.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def panel_schema(labelled: bool = True, spec: PanelSpec = DEFAULT) -> T.StructType:
    """Types of the published panel files."""
    fields = [T.StructField(spec.entity, T.LongType()), T.StructField(spec.period, T.IntegerType())]
    for c in NUMERIC_COLUMNS:
        kind = T.DoubleType() if c in FRACTIONAL_COLUMNS else T.IntegerType()
        fields.append(T.StructField(c, kind))
    fields += [T.StructField(c, T.StringType()) for c in CATEGORICAL_COLUMNS]
    fields += [T.StructField(c, T.BooleanType()) for c in BOOLEAN_COLUMNS]
    if labelled:
        fields.append(T.StructField(spec.label, T.BooleanType()))
    return T.StructType(fields)


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType,
                   spec: PanelSpec = DEFAULT) -> DataFrame:
    """CSV with header and ``True``/``False`` literals; the label becomes 0/1 (SRC1).

    Columns are matched to the header by name, so file column order is free.
    """
    with_header = spark.read.option("header", True).csv(path)
    typed = [F.col(f.name).cast(f.dataType).alias(f.name)
             for f in schema.fields if f.name in with_header.columns]
    missing = [f.name for f in schema.fields if f.name not in with_header.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    df = with_header.select(*typed)
    if spec.label in df.columns:
        df = df.withColumn(spec.label, F.col(spec.label).cast("int"))
    return df


def schema_from_dictionary(dictionary: Sequence[tuple[str, str, str]]) -> T.StructType:
    """Column dictionary rows ``(name, description, type)`` to a commented schema (SRC3)."""
    return T.StructType([
        T.StructField(name, DICTIONARY_TYPES[kind], True, {"comment": text})
        for name, text, kind in dictionary])


def schema_report(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary against the actual columns: present, type, and whether the kinds agree."""
    def kind(t: T.DataType) -> str:
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, T.IntegralType):
            return "int"
        return "float" if isinstance(t, (T.FractionalType, T.DecimalType)) else "string"

    actual = df.sparkSession.createDataFrame(
        [(f.name, kind(f.dataType)) for f in df.schema.fields],
        "column_name string, actual_type string")
    return dictionary.join(actual, "column_name", "full_outer").select(
        "column_name", F.col("type").alias("declared_type"), "actual_type",
        F.coalesce(F.col("type") == F.col("actual_type"), F.lit(False)).alias("matches"))


def source_row_index(df: DataFrame, order: Sequence[str], out: str = "row_ord") -> DataFrame:
    """Stable 0-based row number over a unique order (SRC4), with no single-task sort."""
    from cohortica.functions.ordered import row_numbers
    return row_numbers(df, [], order, out).withColumn(out, F.col(out) - 1)


# Stores whose files a task can open itself; those of others are read by Spark, whole.
STREAMED = {"file": None, "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
_CHUNK = 1 << 23


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for uri in batch.column(0).to_pylist():
            scheme, rest = uri.split(":", 1)
            digest = sha256()
            if scheme == "file":
                stream = open("/" + rest.lstrip("/"), "rb")
            else:
                store, name = pa.fs.FileSystem.from_uri(f"{STREAMED[scheme]}:{rest}")
                stream = store.open_input_stream(name)
            with stream:
                while chunk := stream.read(_CHUNK):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["path", "bytes", "sha256"])


def file_records(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of every file under ``path`` (SRC5, L1).

    Spark only lists the files; each is read in its task chunk by chunk, so a file of any size
    takes a few MB. Spark's file listing leaves out empty files. In stores that only Spark can open a file is one value, below 2 GB.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).load(path))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() in STREAMED:
        return files.select("path", F.col("length").alias("bytes")).mapInArrow(_digests, "path string, bytes long, sha256 string")
    return files.select("path", F.col("length").alias("bytes"),
                        F.sha2("content", 256).alias("sha256"))


def read_in_order(spark: SparkSession, path: str, schema: str, out: str = "row_ord") -> DataFrame:
    """CSV files with header as one table, rows numbered in the order of file names and of lines (SNK1)."""
    place = F.col("_metadata")
    rows = spark.read.schema(schema).option("header", True).csv(path).select(
        "*", place["file_name"].alias("_file"), place["file_block_start"].alias("_block"),
        F.monotonically_increasing_id().alias("_line"))
    return source_row_index(rows, ["_file", "_block", "_line"], out).drop("_file", "_block", "_line")


def read_run_table(spark: SparkSession, path: str, schema: T.StructType,
                   format: str = "parquet") -> DataFrame:
    """A stored prediction / member table with a fixed schema (SRC6)."""
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if format == "csv" else reader).format(format).load(path)


def mean_over_seeds(scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Average of the stored per-seed scores, with the number of seeds (SRC7, E3)."""
    return scores.groupBy(*keys).agg(
        F.avg(score).alias(score), F.count(F.lit(1)).alias("n_seeds"))
