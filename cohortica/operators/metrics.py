"""Exact tie-aware ranking metrics and score summaries.

Every metric first collapses rows to ``(keys, score)`` tie groups, so a hot score
value is one row, and then works on score ranges (see ``functions.ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohortica.functions.ordered import (_SEG, add_ranks, quantiles_wide, range_count, running,
                                         safe_corr, value_ranks, with_ranges)


def checked_score(df: DataFrame, score: str, probability: bool = False) -> Column:
    """The score; NULL, NaN and, for a ``probability``, what lies outside [0, 1] are errors, not ranks."""
    kind, s = df.schema[score].dataType, F.col(score)
    lacking = s.isNull() | F.isnan(score) if isinstance(kind, (T.DoubleType, T.FloatType)) else s.isNull()
    out = F.when(lacking, F.raise_error(F.lit("a score is NULL or NaN")).cast(kind))
    if probability:
        out = out.when((s < 0) | (s > 1), F.raise_error(F.lit("a probability lies outside [0, 1]")).cast(kind))
    return out.otherwise(s)


def checked_label(label: str) -> Column:
    """The label as 0 or 1; anything else is an error."""
    return F.when(F.col(label).isin(0, 1), F.col(label).cast("long")).otherwise(
        F.raise_error(F.lit("a label is not 0 or 1")).cast("long"))


def tie_groups(df: DataFrame, keys: Sequence[str], score: str, label: str,
               weight: str | None = None, probability: bool = False) -> DataFrame:
    """Positive and negative weight per distinct score."""
    y = checked_label(label)
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    return df.groupBy(*keys, checked_score(df, score, probability).alias("_score")).agg(
        F.sum(w * y).alias("_pos"), F.sum(w * (1 - y)).alias("_neg"))


def auc_table(df: DataFrame, keys: Sequence[str], score: str = "score",
              label: str = "objetivo", weight: str | None = None, probability: bool = False) -> DataFrame:
    """Rows, events, AUC and Gini per key; NULL metrics where a class is missing.

    With ``probability`` a score outside [0, 1] is an error. AUC counts correctly ordered pairs. Each score range counts its own pairs and
    its totals; joining two neighbouring ranges only needs those three numbers.
    """
    keys = list(keys)
    inner = keys or ["_all"]
    ties = tie_groups(df if keys else df.withColumn("_all", F.lit(0)), inner, score, label, weight, probability)
    ranged = with_ranges(ties, [*inner, "_score"], range_count(df))
    before = Window.partitionBy(_SEG, *inner).orderBy("_score").rowsBetween(
        Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(before), F.lit(0))
    parts = (ranged.withColumn("_pairs", F.col("_pos") * (below + F.col("_neg") / F.lit(2.0)))
             .groupBy(_SEG, *inner)
             .agg(F.sum("_pairs").alias("_pairs"), F.sum("_pos").alias("_pos"),
                  F.sum("_neg").alias("_neg")))
    earlier = Window.partitionBy(*inner).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    neg_below = F.coalesce(F.sum("_neg").over(earlier), F.lit(0))
    total = (parts.withColumn("_pairs", F.col("_pairs") + F.col("_pos") * neg_below)
             .groupBy(*inner)
             .agg(F.sum("_pairs").alias("_pairs"), F.sum("_pos").alias("_pos"),
                  F.sum("_neg").alias("_neg")))
    auc = F.try_divide(F.col("_pairs"), F.col("_pos").cast("double") * F.col("_neg"))
    return total.select(
        *keys, (F.col("_pos") + F.col("_neg")).cast("long").alias("n_rows"),
        F.col("_pos").cast("long").alias("events"), auc.alias("auc"), (2 * auc - 1).alias("gini"))


def metric_table(df: DataFrame, keys: Sequence[str], score: str = "score",
                 label: str = "objetivo", weight: str | None = None, probability: bool = False) -> DataFrame:
    """Gini, ROC AUC and step-wise average precision per key, from one pass.

    Average precision sums over distinct thresholds from the top; the counts above a
    threshold are the key totals minus the running counts below it.
    """
    keys = list(keys)
    inner = keys or ["_all"]
    ties = tie_groups(df if keys else df.withColumn("_all", F.lit(0)), inner, score, label, weight, probability)
    cum = running(ties, inner, ["_score"], sums={"_pc": "_pos", "_nc": "_neg"},
                  totals={"_p": "_pos", "_n": "_neg"})
    pos_from = F.col("_p") - F.col("_pc") + F.col("_pos")
    neg_from = F.col("_n") - F.col("_nc") + F.col("_neg")
    pairs = F.col("_pos") * (F.col("_nc") - F.col("_neg") / F.lit(2.0))
    total = cum.groupBy(*inner).agg(
        F.sum(pairs).alias("_pairs"), F.max("_p").alias("_p"), F.max("_n").alias("_n"),
        F.sum(F.col("_pos") * F.try_divide(pos_from.cast("double"), pos_from + neg_from)).alias("_ap"))
    auc = F.try_divide(F.col("_pairs"), F.col("_p").cast("double") * F.col("_n"))
    return total.select(
        *keys, (F.col("_p") + F.col("_n")).cast("long").alias("n_rows"), F.col("_p").cast("long").alias("events"),
        auc.alias("auc"), (2 * auc - 1).alias("gini"),
        F.when(F.col("_n") > 0, F.try_divide(F.col("_ap"), F.col("_p"))).alias("ap"))


def average_precision(df: DataFrame, keys: Sequence[str], score: str = "score",
                      label: str = "objetivo", weight: str | None = None) -> DataFrame:
    """Average precision per key."""
    return metric_table(df, keys, score, label, weight).select(*keys, "ap")


def check_scores(df: DataFrame, score: str, label: str) -> DataFrame:
    """Counts of invalid labels and scores, one row; all zero for a valid table."""
    s, y = F.col(score), F.col(label)
    bad = s.isNull() | F.isnan(s.cast("double")) | (s < 0) | (s > 1)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad_scores"),
        F.coalesce(F.sum((y.isNull() | ~y.isin(0, 1)).cast("long")), F.lit(0)).alias("bad_labels"),
        F.sum((y == 1).cast("long")).alias("positives"),
        F.sum((y == 0).cast("long")).alias("negatives"))


def require_both_classes(metrics: DataFrame) -> DataFrame:
    """Fail the query when a key has a single class, instead of returning NULL."""
    checked = F.when(F.col("gini").isNull(), F.raise_error(
        F.lit("a group has a single class; its Gini is undefined"))).otherwise(F.col("gini"))
    return metrics.withColumn("gini", checked.cast("double"))


def monthly_summary(metrics: DataFrame, by: Sequence[str] = (), metric: str = "gini",
                    ddof: int = 0, undefined: str = "error") -> DataFrame:
    """Simple mean and standard deviation of a metric over periods.

    A period without a value (a single class) is an error. With ``undefined="report"`` it is
    left out of the mean and counted in ``undefined_periods``.
    """
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    if undefined not in ("error", "report"):
        raise ValueError(f"unknown treatment {undefined}")
    value, extra = F.col(metric), []
    if undefined == "error":
        value = F.when(value.isNull(), F.raise_error(F.lit(f"{metric} is undefined in a period")).cast("double")).otherwise(value)
    else:
        extra = [F.sum(F.col(metric).isNull().cast("long")).alias("undefined_periods")]
    grouped = metrics.groupBy(*by) if by else metrics
    return grouped.agg(F.count(value).alias("n_periods"), F.avg(value).alias(f"mean_{metric}"),
                       std(value).alias(f"std_{metric}"), *extra)


def metric_slices(df: DataFrame, period: str, cohort: str, score: str = "score",
                  label: str = "objetivo", probability: bool = False) -> DataFrame:
    """Overall, per period and per cohort metrics in one pass.

    Each row is emitted once per slice it belongs to and the slice is the key.
    """
    slices = F.array(
        F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value")),
        F.struct(F.lit("period").alias("slice"), F.col(period).cast("string").alias("value")),
        F.struct(F.lit("cohort").alias("slice"),
                 F.when(F.col(cohort), "recurrent").when(~F.col(cohort), "new").otherwise("unknown").alias("value")))
    rows = df.select(score, label, F.explode(slices).alias("_s")).select(score, label, "_s.*")
    return metric_table(rows, ["slice", "value"], score, label, probability=probability)


def univariate_screen(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Gini of every numeric column as a score."""
    rows = df.select(label, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [label], list(columns), "feature", "value").where(F.col("value").isNotNull())
    return auc_table(rows, ["feature"], "value", label)


def score_distribution(df: DataFrame, score: str, probs: dict[str, float],
                       by: Sequence[str] = ()) -> DataFrame:
    """Rows, mean, population std, range and exact quantiles."""
    by = list(by)
    base = (df.groupBy(*by) if by else df).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"))
    q = quantiles_wide(df, by, score, probs)
    return base.join(q, by, "left") if by else base.crossJoin(q)


def correlation(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson and Spearman correlation of two columns."""
    by = list(by)
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = add_ranks(pairs, by, {a: "_ra", b: "_rb"})
    return (ranked.groupBy(*by) if by else ranked).agg(
        F.count(F.lit(1)).alias("n_rows"), safe_corr(a, b).alias("pearson"),
        safe_corr("_ra", "_rb").alias("spearman"))


def ks_uniform(df: DataFrame, value: str, low: float = 0.0, high: float = 1.0,
               by: Sequence[str] = ()) -> DataFrame:
    """Kolmogorov-Smirnov distance to the uniform law on [low, high]."""
    by = list(by)
    ranks = value_ranks(df, by, value)
    cdf = F.least(F.greatest((F.col(value) - F.lit(low)) / F.lit(high - low), F.lit(0.0)), F.lit(1.0))
    gap = F.greatest((F.col("n_before") + F.col("n")) / F.col("n_total") - cdf,
                     cdf - F.col("n_before") / F.col("n_total"))
    return (ranks.groupBy(*by) if by else ranks).agg(
        F.max("n_total").alias("n_rows"), F.max(gap).alias("ks"))


def ks_pvalue(ks: Column, n: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value, as a finite series in a column expression."""
    lam = F.sqrt(n.cast("double")) * ks
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0)))


def calibration(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Mean prediction against event rate, and the mean residual."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(score).alias("mean_score"),
        F.avg(label).alias("event_rate"), F.avg(F.col(label) - F.col(score)).alias("mean_residual"))


def seed_spread(df: DataFrame, model: str, seed: str, period: str, score: str,
                label: str) -> DataFrame:
    """Spread over seeds of the mean monthly Gini."""
    per_seed = monthly_summary(auc_table(df, [model, seed, period], score, label), [model, seed])
    return per_seed.groupBy(model).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("mean_gini").alias("mean"),
        F.stddev_samp("mean_gini").alias("std"), F.min("mean_gini").alias("min"),
        F.max("mean_gini").alias("max"))
