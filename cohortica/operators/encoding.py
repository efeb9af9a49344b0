"""Category codes, quantile bins, causal target encoding, one-hot design."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortica.functions.features import known_category
from cohortica.functions.ordered import quantiles, row_numbers
from cohortica.functions.stored import stored
from cohortica.spec import DEFAULT, PanelSpec


def category_vocabulary(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, code)``: codes are positions in the sorted training values."""
    long = train.select(*[known_category(c).alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    values = long.distinct()
    return row_numbers(values, ["column"], ["value"], "code").withColumn(
        "code", (F.col("code") - 1).cast("int"))


def _joined(rows: DataFrame, table: DataFrame, match: dict[str, Column], prefix: str) -> DataFrame:
    """Left equi join on equal or both NULL values; ``match`` maps columns of ``table`` to expressions over ``rows``."""
    renamed = table.select(*[F.col(c).alias(f"{prefix}{c}") for c in table.columns])
    on = reduce(lambda x, y: x & y, [e.eqNullSafe(F.col(f"{prefix}{c}")) for c, e in match.items()])
    return rows.join(renamed, on, "left").drop(*[f"{prefix}{c}" for c in match])


def encode_categories(df: DataFrame, vocabulary: DataFrame, columns: Sequence[str],
                      row_key: Sequence[str]) -> DataFrame:
    """Codes of several category columns; an unseen value gets the next free code.

    Wide rows meet one vocabulary a column; they are never turned into long ones.
    """
    words = stored(vocabulary.select("column", "value", "code"), "vocabulary")
    sizes = words.groupBy().agg(*[F.count(F.when(F.col("column") == c, 1)).cast("int").alias(f"_n_{c}") for c in columns])
    out = df.select(*row_key, *[known_category(c).alias(c) for c in columns])
    for c in columns:
        out = _joined(out, words.where(F.col("column") == c).select("value", "code"), {"value": F.col(c)}, f"_{c}_")
    codes = [F.coalesce(F.col(f"_{c}_code"), F.col(f"_n_{c}")).alias(f"{c}_code") for c in columns]
    return out.crossJoin(F.broadcast(sizes)).select(*row_key, *codes)                       # one row


def causal_target_encoding(df: DataFrame, keys: dict[str, Column], smoothing: float = 50.0,
                           row_key: Sequence[str] | None = None,
                           spec: PanelSpec = DEFAULT) -> DataFrame:
    """Smoothed event rate of each key over strictly earlier periods.

    Rows are collapsed to (key column, key, period) first; the running sums then
    see at most one row per period, and same-period rows cannot leak. The wide rows meet
    the encodings of one key after the other and are never turned into long ones.
    """
    row_key = list(row_key or spec.keys)
    y = F.col(spec.label).cast("double")
    base = df.select(*row_key, *[c for c in [spec.period] if c not in row_key],
                     F.coalesce(y, F.lit(0.0)).alias("_y"), y.isNotNull().cast("double").alias("_n"),
                     *[expr.alias(name) for name, expr in keys.items()])
    long = base.unpivot([c for c in base.columns if c not in keys], list(keys), "_column", "_key")
    by_key = long.groupBy("_column", "_key", spec.period).agg(
        F.sum("_y").alias("_y"), F.sum("_n").alias("_n"))
    earlier = Window.partitionBy("_column", "_key").orderBy(spec.period).rowsBetween(
        Window.unboundedPreceding, -1)
    history = by_key.select(
        "_column", "_key", spec.period,
        F.coalesce(F.sum("_y").over(earlier), F.lit(0.0)).alias("_yb"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0.0)).alias("_nb"))
    # One row per period: a window over a handful of rows.
    monthly = base.groupBy(spec.period).agg(F.sum("_y").alias("_y"), F.sum("_n").alias("_n"))
    past = Window.partitionBy(F.lit(0)).orderBy(spec.period).rowsBetween(Window.unboundedPreceding, -1)
    prior = monthly.select(spec.period, F.try_divide(
        F.sum("_y").over(past), F.sum("_n").over(past)).alias("_prior"))
    encoded = stored(history.join(prior, spec.period).select(
        "_column", "_key", spec.period,
        ((F.col("_yb") + smoothing * F.col("_prior")) / (F.col("_nb") + smoothing)).alias("te")), "encodings")
    out = df.select(*row_key, F.col(spec.period).alias("_period"), *[expr.alias(f"_key_{name}") for name, expr in keys.items()])
    for name in keys:
        table = encoded.where(F.col("_column") == name).select("_key", F.col(spec.period).alias("_at"), "te")
        out = _joined(out, table, {"_key": F.col(f"_key_{name}"), "_at": F.col("_period")}, f"_{name}_")
    return out.select(*row_key, *[F.col(f"_{name}_te").alias(f"te_{name}") for name in keys])


def bin_edges(train: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Distinct training quantile edges per column, as a sorted array."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    probs = [i / bins for i in range(bins + 1)]
    return quantiles(long, ["column"], "value", probs).groupBy("column").agg(
        F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("edges"))


def bin_index(value: Column, edges: Column, right_closed: bool = False) -> Column:
    """0-based bin of a value; values outside the edges fall in the outer bins.

    Inner edges belong to the bin above them, or to the bin below with ``right_closed``.
    """
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    test = (lambda e: e < value) if right_closed else (lambda e: e <= value)
    return F.when(value.isNotNull(), F.size(F.filter(inner, test)))


def quantile_bins(train: DataFrame, df: DataFrame, columns: Sequence[str], bins: int,
                  row_key: Sequence[str], right_closed: bool = False) -> DataFrame:
    """Bins of ``df`` from the training edges (P18); one row per key."""
    edges = bin_edges(train, columns, bins).agg(F.map_from_entries(F.collect_list(F.struct("column", "edges"))).alias("_edges"))
    rows = df.select(*row_key, *[F.col(c).cast("double").alias(c) for c in columns]).crossJoin(F.broadcast(edges))   # one row
    return rows.select(*row_key, *[bin_index(F.col(c), F.col("_edges")[c], right_closed).alias(f"{c}_bin") for c in columns])


def cross_keys(band: str, bins: Sequence[str]) -> list[Column]:
    """``band_feature_bin`` strings."""
    return [F.concat_ws("_", F.col(band), F.lit(b.removesuffix("_bin")), F.col(b).cast("string")).alias(b)
            for b in bins]


def design_stats(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Column list of a one-hot design with mean and population std (P20).

    The first sorted training level of each category is the reference and is
    dropped, as are constant columns.
    """
    vocab = category_vocabulary(train, categorical)
    total = train.agg(F.count(F.lit(1)).alias("_rows"))
    level_counts = train.select(*[known_category(c).alias(c) for c in categorical]).unpivot(
        [], list(categorical), "column", "value").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("_n"))
    dummies = level_counts.join(vocab.where(F.col("code") > 0), ["column", "value"]).crossJoin(total)
    share = F.col("_n") / F.col("_rows")
    dummy_rows = dummies.select(
        F.concat_ws("_", "column", "value").alias("feature"), share.alias("mean"),
        F.sqrt(share * (1 - share)).alias("std"))
    numbers = train.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        [], list(numeric), "feature", "value")
    numeric_rows = numbers.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return numeric_rows.unionByName(dummy_rows).where(F.col("std") > 0)
