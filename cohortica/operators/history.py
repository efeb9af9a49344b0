"""Per-entity history, trajectory and risk-interval features.

All windows share one ``partitionBy(entity).orderBy(period)``, so Spark plans one
exchange and one sort for any combination of them. An entity has at most one row
per period, which bounds every window partition by the number of periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortica.functions.periods import ordinal
from cohortica.spec import DEFAULT, PanelSpec

# Output names of the history features.
HISTORY_FEATURES = [
    "mes_primera_aparicion", "meses_en_riesgo", "n_observaciones_previas",
    "cliente_recurrente", "meses_desde_entrada",
]


def _by_entity(spec: PanelSpec):
    return Window.partitionBy(spec.entity).orderBy(spec.period)


def _upto(spec: PanelSpec):
    return _by_entity(spec).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def add_history(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Prior rows, first period, months since entry; never reads the label."""
    w, upto = _by_entity(spec), _upto(spec)
    first = F.min(spec.period).over(upto)
    since = ordinal(spec.period) - ordinal(first)
    prior = F.row_number().over(w) - 1
    return df.select(
        "*", first.cast("int").alias("mes_primera_aparicion"),
        since.alias("meses_desde_entrada"), (since + 1).alias("meses_en_riesgo"),
        prior.alias("n_observaciones_previas"), (prior > 0).alias("cliente_recurrente"))


def months_in_panel(spec: PanelSpec = DEFAULT) -> Column:
    """1-based count of the entity's rows so far."""
    return F.row_number().over(_by_entity(spec))


def lags(value: str, spec: PanelSpec = DEFAULT) -> dict[str, Column]:
    """Previous observations, not previous calendar months."""
    w = _by_entity(spec)
    v = F.col(value)
    lag1 = F.lag(v, 1).over(w)
    return {"lag1": lag1, "lag2": F.lag(v, 2).over(w), "delta": v - lag1}


def trajectory(df: DataFrame, value: str, prefix: str = "interaction",
               spec: PanelSpec = DEFAULT) -> DataFrame:
    """Lags, expanding statistics, expanding slope and resets of one column."""
    w, upto = _by_entity(spec), _upto(spec)
    v = F.col(value).cast("double")
    lag = F.lag(v, 1).over(w)
    base = df.select(
        "*",
        (ordinal(spec.period) - F.min(ordinal(spec.period)).over(upto)).cast("double").alias("_t"),
        v.alias("_v"), lag.alias("_lag1"), F.lag(v, 2).over(w).alias("_lag2"),
        F.coalesce((v < lag).cast("int"), F.lit(0)).alias("_reset"))
    n = F.count(F.lit(1)).over(upto)
    st, sv = F.sum("_t").over(upto), F.sum("_v").over(upto)
    stt = F.sum(F.col("_t") * F.col("_t")).over(upto)
    stv = F.sum(F.col("_t") * F.col("_v")).over(upto)
    spread = n * stt - st * st
    return base.select(
        *df.columns,
        F.col("_lag1").alias(f"{prefix}_lag1"), F.col("_lag2").alias(f"{prefix}_lag2"),
        (F.col("_v") - F.col("_lag1")).alias(f"{prefix}_delta"),
        F.try_divide(n * stv - st * sv, spread).alias(f"{prefix}_slope"),
        F.min("_v").over(upto).alias(f"{prefix}_min"),
        F.max("_v").over(upto).alias(f"{prefix}_max"),
        (sv / n).alias(f"{prefix}_mean"),
        F.col("_reset").alias(f"{prefix}_reset"),
        F.sum("_reset").over(upto).cast("int").alias(f"{prefix}_resets"))


def equality_with_previous(df: DataFrame, value: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Share of repeat rows whose value equals the entity's previous value."""
    prev = F.lag(value).over(_by_entity(spec))
    rows = df.select((F.col(value) == prev).cast("int").alias("_same"), prev.isNotNull().alias("_repeat"))
    return rows.where("_repeat").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("_same").alias("same_share"))


def flag_transitions(df: DataFrame, flag: Column, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Counts of (previous flag, flag) over consecutive rows of an entity."""
    flagged = df.withColumn("_flag", flag)
    prev = F.lag("_flag").over(_by_entity(spec))
    return (flagged.select(prev.alias("previous"), F.col("_flag").alias("current"))
            .where(F.col("previous").isNotNull()).groupBy("previous", "current")
            .agg(F.count(F.lit(1)).alias("n_rows")))


def period_gap(spec: PanelSpec = DEFAULT, calendar: bool = False) -> Column:
    """Difference to the previous period, raw YYYYMM or in months."""
    p = ordinal(spec.period) if calendar else F.col(spec.period)
    return p - F.lag(p).over(_by_entity(spec))


def risk_intervals(df: DataFrame, spec: PanelSpec = DEFAULT, strict: bool = True) -> DataFrame:
    """``(start, stop]`` in months since entry, and the censoring flag."""
    w, upto = _by_entity(spec), _upto(spec)
    prior = F.sum(spec.label).over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = ordinal(spec.period) - ordinal(F.min(spec.period).over(upto))
    last = F.lead(spec.period).over(w).isNull()
    out = df.select("*", start.alias("_start"), last.alias("_last"), prior.alias("_prior"))
    begin = F.col("_start")
    if strict:
        begin = F.when(F.col("_prior") > 0, F.raise_error(
            F.lit("rows after the first event violate the risk set")).cast("int")).otherwise(begin)
    return out.select(
        *df.columns, begin.alias("start"), (F.col("_start") + 1).alias("stop"),
        (F.col("_last") & (F.col(spec.label) == 0)).alias("censored_last_observation"))


def with_cohort(df: DataFrame, out: str = "cohort", spec: PanelSpec = DEFAULT) -> DataFrame:
    """First period of the entity, from rows up to the current one."""
    return df.withColumn(out, F.min(spec.period).over(_upto(spec)).cast("int"))


def cohort_survival(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Share of the entry cohort still present, and its initial size.

    Counts are aggregated to (cohort, period) first; no window over a cohort.
    """
    rows = with_cohort(df, "cohort", spec)
    present = rows.groupBy("cohort", spec.period).agg(F.count(F.lit(1)).alias("_present"))
    initial = present.where(F.col("cohort") == F.col(spec.period)).select(
        "cohort", F.col("_present").alias("cohort_size_initial"))
    table = present.join(initial, "cohort").select(
        "cohort", spec.period, "cohort_size_initial",
        (F.col("_present") / F.col("cohort_size_initial")).alias("cohort_survival"))
    return rows.join(table, ["cohort", spec.period])


def cohort_ranks(df: DataFrame, columns: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Percentile ranks inside (entry cohort, period)."""
    from cohortica.functions.ordered import pct_ranks
    rows = with_cohort(df, "cohort", spec)
    return pct_ranks(rows, spec.keys, ["cohort", spec.period], columns, prefix="cohort_rk_")
