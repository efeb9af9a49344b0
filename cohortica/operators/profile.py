"""Exploratory tables: rates, histograms, crosstabs, associations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortica.functions.features import cell_key
from cohortica.functions.ordered import pct_rank, quantiles_wide, safe_corr
from cohortica.operators.encoding import bin_edges, bin_index
from cohortica.operators.history import months_in_panel, period_gap
from cohortica.spec import DEFAULT, PanelSpec



def n_rows() -> Column:
    return F.count(F.lit(1)).alias("n_rows")


def rate_by(df: DataFrame, by: Sequence[str | Column], label: str) -> DataFrame:
    """Rows, events and event rate per group."""
    return df.groupBy(*by).agg(n_rows(), F.sum(label).alias("events"), F.avg(label).alias("rate"))


def distinct_entities(tables: dict[str, DataFrame], entity: str) -> DataFrame:
    """Exact distinct entities per table (A2)."""
    out = None
    for name, df in tables.items():
        part = df.select(entity).distinct().agg(F.count(F.lit(1)).alias("n_entities")).select(
            F.lit(name).alias("table"), "n_entities")
        out = part if out is None else out.unionByName(part)
    return out


def periods_per_entity(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Histogram of the number of distinct periods (A3)."""
    per = df.select(*spec.keys).distinct().groupBy(spec.entity).agg(F.count(F.lit(1)).alias("n_periods"))
    return per.groupBy("n_periods").agg(F.count(F.lit(1)).alias("n_entities"))


def gap_histogram(df: DataFrame, top: int = 5, calendar: bool = False,
                  spec: PanelSpec = DEFAULT) -> DataFrame:
    """Most frequent differences to the previous period (A4)."""
    gaps = df.select(period_gap(spec, calendar).alias("gap")).where(F.col("gap").isNotNull())
    return gaps.groupBy("gap").agg(n_rows()).orderBy(F.desc("n_rows"), "gap").limit(top)


def entry_histogram(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Entities by first period (A5)."""
    first = df.groupBy(spec.entity).agg(F.min(spec.period).alias("entry"))
    return first.groupBy("entry").agg(F.count(F.lit(1)).alias("n_entities"))


def variability(df: DataFrame, columns: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Share of entities in which a column takes more than one value.

    Smallest against largest value answers the question with two mergeable
    aggregates; no distinct sets are kept.
    """
    varies = df.groupBy(spec.entity).agg(*[
        F.coalesce((F.min(c) != F.max(c)).cast("int"), F.lit(0)).alias(c) for c in columns])
    return varies.unpivot([], list(columns), "column", "_v").groupBy("column").agg(
        F.avg("_v").alias("varying_share"))


def category_rates(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Size and event rate per value of every category column."""
    long = df.select(label, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [label], list(columns), "column", "value")
    return rate_by(long, ["column", "value"], label)


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
             probs: dict[str, float] | None = None) -> DataFrame:
    """Count, mean, sample std, range and exact quantiles, one row per column.

    A column or group without any value keeps its row, with a count of 0 and NULL figures.
    """
    by = list(by)
    probs = probs or {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        by, list(columns), "column", "value")
    keys = [*by, "column"]
    base = long.groupBy(*keys).agg(
        F.count("value").alias("n_rows"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return base.join(quantiles_wide(long, keys, "value", probs), keys, "left")


def modal_values(df: DataFrame, columns: Sequence[str], top: int = 3) -> DataFrame:
    """Distinct count and the most frequent values of every column.

    ``row_number() <= top`` is evaluated before the shuffle on each map task too.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    counts = long.groupBy("column", "value").agg(n_rows())
    distinct = counts.groupBy("column").agg(F.count("value").alias("n_distinct"))
    order = Window.partitionBy("column").orderBy(F.desc("n_rows"), "value")
    best = counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)
    return best.join(distinct, "column")


def decile_rates(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Event rate per quantile bin; repeated edges merged, bins closed on the right (A10)."""
    edges = F.broadcast(bin_edges(df, columns, bins))  # one row per column, ``bins + 1`` doubles
    long = df.select(label, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [label], list(columns), "column", "value").join(edges, "column")
    binned = long.withColumn("bin", bin_index(F.col("value"), F.col("edges"), right_closed=True))
    return rate_by(binned, ["column", "bin"], label)


def crosstab(df: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
    """Counts of value pairs with the share inside the first value."""
    ca, cb = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    counts = df.groupBy(ca.alias("a"), cb.alias("b")).agg(n_rows())
    rows = df.groupBy(ca.alias("a")).agg(F.count(F.lit(1)).alias("_total"))
    return counts.join(rows, "a").select("a", "b", "n_rows", (F.col("n_rows") / F.col("_total")).alias("share"))


def pivot_rates(df: DataFrame, index: Sequence[str | Column], column: str, values: Sequence,
                label: str) -> DataFrame:
    """Event rate and size by index and column, with fixed output columns."""
    return df.groupBy(*index).pivot(column, list(values)).agg(
        F.avg(label).alias("rate"), F.count(F.lit(1)).alias("n"))


def group_means(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Means of numeric columns per group."""
    return df.groupBy(by).agg(*[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns])


def group_median(df: DataFrame, by: str, column: str) -> DataFrame:
    return quantiles_wide(df, [by], column, {f"median_{column}": 0.5})


def collapse_entities(df: DataFrame, static: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row per entity: first static values, ever-event flag, entry and row count."""
    return df.groupBy(spec.entity).agg(
        *[F.min_by(c, spec.period).alias(c) for c in static],
        F.max(spec.label).alias(spec.label), F.min(spec.period).alias("first_period"),
        F.count(F.lit(1)).alias("n_periods"))


def spearman_matrix(df: DataFrame, columns: Sequence[str], row_key: Sequence[str],
                    threshold: float | None = None) -> DataFrame:
    """Rank correlation of every column pair (A15): ranks in one pass, all pairs in one aggregate."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    ranked = pct_rank(df.select(*row_key, F.posexplode(values).alias("_column", "_value")), ["_column"], "_value", "_rank")
    ranks = ranked.groupBy(*row_key).agg(*[F.max(F.when(F.col("_column") == i, F.col("_rank"))).alias(c) for i, c in enumerate(columns)])
    pairs = list(combinations(columns, 2))
    wide = ranks.agg(*[safe_corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    entry = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("spearman"))
                      for i, (a, b) in enumerate(pairs)])
    out = wide.select(F.inline(entry))
    return out if threshold is None else out.where(F.abs("spearman") > threshold)


def cramers_v(df: DataFrame, columns: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Cramér's V of every category pair, Yates-corrected for 2 x 2 tables.

    Cells with no rows still count: their contribution to chi-square is the part
    of the expected total that no observed cell covers, so no grid of all value
    combinations is built.
    """
    pairs = F.array(*[
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"),
                 F.col(x).cast("string").alias("va"), F.col(y).cast("string").alias("vb"))
        for x, y in combinations(columns, 2)])
    cells = df.select(F.inline(pairs)).groupBy("a", "b", "va", "vb").agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("a", "b", "va").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("a", "b", "vb").agg(F.sum("o").alias("cb"))
    size = rows.groupBy("a", "b").agg(F.sum("ra").alias("n"), F.count(F.lit(1)).alias("r")).join(
        cols.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")), ["a", "b"])
    full = cells.join(rows, ["a", "b", "va"]).join(cols, ["a", "b", "vb"]).join(size, ["a", "b"])
    expected = F.col("ra") * F.col("cb") / F.col("n")
    gap = F.abs(F.col("o") - expected)
    two_by_two = (F.col("r") == 2) & (F.col("c") == 2)
    gap = F.when(two_by_two, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    part = full.select("a", "b", "n", "r", "c", "o", expected.alias("e"), (gap * gap / expected).alias("chi"))
    total = part.groupBy("a", "b").agg(
        F.sum("chi").alias("chi"), F.sum("e").alias("covered"), F.max("n").alias("n"),
        F.max("r").alias("r"), F.max("c").alias("c"), F.count(F.lit(1)).alias("cells"))
    # An empty cell of a larger table adds its expected count. In a 2 x 2 table all
    # four gaps are equal, so its empty cells share the uncovered expectation evenly.
    empty = F.col("n") - F.col("covered")
    holes = F.col("r") * F.col("c") - F.col("cells")
    each = F.try_divide(empty, holes)
    empty_chi = F.when((F.col("r") == 2) & (F.col("c") == 2),
                       holes * F.pow(each - F.least(F.lit(0.5), each), 2) / each).otherwise(empty)
    missing = holes > 0
    chi = F.col("chi") + F.when(missing, empty_chi).otherwise(F.lit(0.0))
    v = F.sqrt(F.try_divide(chi, F.col("n") * (F.least("r", "c") - 1)))
    out = total.select("a", "b", v.alias("cramers_v"))
    return out if threshold is None else out.where(F.col("cramers_v") > threshold)


def cell_rates(train: DataFrame, score: DataFrame, band: str = "banda_riesgo", strength: float = 200.0,
               spec: PanelSpec = DEFAULT) -> DataFrame:
    """Empirical-Bayes event rate of each row's cell, shrunk to its band."""
    bands = train.groupBy(band).agg(F.avg(spec.label).alias("_band_rate"))
    cells = train.withColumn("_cell", cell_key()).groupBy("_cell", band).agg(
        F.sum(spec.label).alias("_y"), F.count(F.lit(1)).alias("_n"))
    post = cells.join(bands, band).select(
        "_cell", ((F.col("_y") + strength * F.col("_band_rate")) / (F.col("_n") + strength)).alias("_post"))
    scored = score.withColumn("_cell", cell_key()).join(post, "_cell", "left").join(bands, band, "left")
    return scored.select(*score.columns, F.coalesce("_post", "_band_rate").alias("cell_rate"))


def copy_drift(df: DataFrame, a: str, b: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Share of copied values per period against (12 - m) / 11, and rates by copy flag."""
    same = F.col(a) == F.col(b)
    return df.groupBy(spec.period).agg(
        n_rows(), F.avg(same.cast("int")).alias("copy_share"),
        F.avg(F.when(same, F.col(spec.label))).alias("rate_copy"),
        F.avg(F.when(~same, F.col(spec.label))).alias("rate_other"),
    ).withColumn("theoretical_share", (F.lit(12) - F.pmod(F.col(spec.period), F.lit(100))) / F.lit(11.0))


def entering_and_continuing(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Entities entering and continuing per period."""
    first = F.min(spec.period).over(Window.partitionBy(spec.entity))
    return df.select(spec.period, (F.col(spec.period) == first).cast("int").alias("_new")).groupBy(
        spec.period).agg(F.sum("_new").alias("entering"), F.sum(1 - F.col("_new")).alias("continuing"))


def id_range_by_entry(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Smallest and largest id of each entry cohort."""
    first = df.groupBy(spec.entity).agg(F.min(spec.period).alias("entry"))
    return first.groupBy("entry").agg(F.min(spec.entity).alias("min_id"), F.max(spec.entity).alias("max_id"))


def rate_by_tenure(df: DataFrame, cap: int | None = None, copy: Column | None = None,
                   spec: PanelSpec = DEFAULT) -> DataFrame:
    """Event rate and copy share by months in panel."""
    k = months_in_panel(spec)
    rows = df.select(spec.label, (k if cap is None else F.least(k, F.lit(cap))).alias("k"),
                     (F.lit(None).cast("int") if copy is None else copy.cast("int")).alias("_copy"))
    return rows.groupBy("k").agg(n_rows(), F.avg(spec.label).alias("rate"), F.avg("_copy").alias("copy_share"))


def residual_table(df: DataFrame, bins: Sequence[Column | str], score: str, label: str) -> DataFrame:
    """Observed, expected and their difference per bin."""
    return df.groupBy(*bins).agg(n_rows(), F.avg(label).alias("observed"), F.avg(score).alias("expected"),
                                 F.avg(F.col(label) - F.col(score)).alias("residual"))


def timing_rollup(runs: DataFrame, by: Sequence[str], seconds: str) -> DataFrame:
    """Count, mean and range of run seconds."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg(seconds).alias("mean_seconds"),
        F.min(seconds).alias("min_seconds"), F.max(seconds).alias("max_seconds"))


def entity_overlap(folds: DataFrame, entity: str, fold: str = "fold", role: str = "role") -> DataFrame:
    """Distinct training and validation entities per fold and how many are in both."""
    per = folds.groupBy(fold, entity).agg(
        F.max((F.col(role) == "train").cast("int")).alias("_t"),
        F.max((F.col(role) == "valid").cast("int")).alias("_v"))
    return per.groupBy(fold).agg(
        F.sum("_t").alias("train_entities"), F.sum("_v").alias("valid_entities"),
        F.sum(F.col("_t") * F.col("_v")).alias("overlap"))
