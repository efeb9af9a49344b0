"""Feature matrices and the feature-family registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from cohortica.functions.features import (behavioural_ratios, interaction_gap, month_columns,
                                          pair_keys)
from cohortica.functions.ordered import pct_rank, pct_ranks
from cohortica.operators.calendar import add_calendar
from cohortica.operators.encoding import causal_target_encoding
from cohortica.operators.history import (HISTORY_FEATURES, add_history, cohort_ranks,
                                         cohort_survival)
from cohortica.spec import CATEGORICAL_COLUMNS, DEFAULT, NUMERIC_COLUMNS, PanelSpec

Family = Callable[[DataFrame], DataFrame]


def variant(df: DataFrame, name: str, spec: PanelSpec = DEFAULT) -> tuple[DataFrame, list[str]]:
    """Keyed table and feature list of ``clean``, ``history`` or ``id_raw``.

    The key travels with the features instead of row positions; the label is never
    a feature.
    """
    if name not in ("clean", "history", "id_raw"):
        raise ValueError(f"unknown variant {name}")
    out = add_history(df, spec) if name == "history" else df
    hidden = {spec.label, spec.entity}
    if name == "id_raw":
        hidden.discard(spec.entity)
    if name != "history":
        hidden |= set(HISTORY_FEATURES)
    return out, [c for c in out.columns if c not in hidden]


def matrix(df: DataFrame, name: str, encoding: str = "index", base: int = 202601,
           spec: PanelSpec = DEFAULT) -> tuple[DataFrame, list[str]]:
    """Matrices A (base), B (month), C (history), D (both) with their feature lists."""
    if name not in "ABCD":
        raise ValueError(f"unknown matrix {name}")
    features = [c for c in df.columns if c not in (spec.entity, spec.period, spec.label)]
    out = df
    if name in "CD":
        out = add_history(out, spec)
        features += HISTORY_FEATURES
    if name in "BD":
        extra = month_columns(encoding, spec.period, base)
        out = out.select("*", *[e.alias(n) for n, e in extra.items()])
        features += list(extra)
    return out, features


def transform(df: DataFrame, how: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Column treatments of the drifting column and the risk band (P5)."""
    recent = "dias_ultima_interaccion"
    if how == "none":
        return df
    if how == "drop_interaccion":
        return df.drop(recent)
    if how == "drop_both":
        return df.drop(recent, "dias_ultima_transaccion")
    if how == "rank_interaccion":
        return pct_rank(df, [spec.period], recent, "_rk").withColumn(recent, F.col("_rk")).drop("_rk")
    if how == "ordinal_band":
        from cohortica.functions.features import band_ordinal
        return df.withColumn("banda_riesgo_ord", band_ordinal()).drop("banda_riesgo")
    raise ValueError(f"unknown transform {how}")


def _ratios(df: DataFrame, spec: PanelSpec) -> DataFrame:
    gap = df.select(*spec.keys, *[e.alias(n) for n, e in behavioural_ratios().items()],
                    interaction_gap().alias("_gap"))
    return pct_rank(gap, [spec.period], "_gap", "gap_interaccion_rank").drop("_gap")


def _cohort(df: DataFrame, spec: PanelSpec) -> DataFrame:
    sizes = cohort_survival(df.select(*spec.keys), spec).select(
        *spec.keys, "cohort_survival", "cohort_size_initial")
    tenure = add_history(df.select(*spec.keys), spec).select(*spec.keys, "meses_en_riesgo")
    return (cohort_ranks(df.select(*spec.keys, *NUMERIC_COLUMNS), NUMERIC_COLUMNS, spec)
            .join(sizes, spec.keys).join(tenure, spec.keys))


def _calendar(df: DataFrame, flags: bool, spec: PanelSpec) -> DataFrame:
    days = df.select(*spec.keys, "dia_preferido_pago")
    return add_calendar(days, spec.period, "dia_preferido_pago", flags=flags).drop("dia_preferido_pago")


def families(spec: PanelSpec = DEFAULT) -> dict[str, tuple[Family, list[str]]]:
    """Registry: family name to a function giving keyed extra columns, and columns to drop."""
    return {
        "F1_calendar": (lambda df: _calendar(df, False, spec), []),
        "F1g_calendar_flags": (lambda df: _calendar(df, True, spec), []),
        "F2_ratios": (lambda df: _ratios(df, spec), []),
        "F3_rank_all": (lambda df: pct_ranks(df, spec.keys, [spec.period], NUMERIC_COLUMNS), []),
        "F3r_rank_replace": (
            lambda df: pct_ranks(df, spec.keys, [spec.period], NUMERIC_COLUMNS), NUMERIC_COLUMNS),
        "F4_target_enc": (
            lambda df: causal_target_encoding(df, pair_keys(CATEGORICAL_COLUMNS), spec=spec), []),
        "F5_cohort": (lambda df: _cohort(df, spec), []),
    }


def apply_family(df: DataFrame, base: DataFrame, name: str, spec: PanelSpec = DEFAULT,
                 registry: dict[str, tuple[Family, list[str]]] | None = None) -> DataFrame:
    """Append one family to ``base``; a duplicate column name is an error."""
    fn, dropped = (registry or families(spec))[name]
    extra = fn(df)
    out = base.drop(*dropped)
    added = [c for c in extra.columns if c not in spec.keys]
    if name == "F5_cohort" and "meses_en_riesgo" in out.columns:
        added.remove("meses_en_riesgo")
    clash = sorted(set(added) & set(out.columns))
    if clash:
        raise ValueError(f"family {name} repeats columns {clash}")
    return out.join(extra.select(*spec.keys, *added), spec.keys)


def apply_families(df: DataFrame, base: DataFrame, names: Sequence[str],
                   spec: PanelSpec = DEFAULT) -> DataFrame:
    """Union of families; a column that is already present is skipped."""
    registry = families(spec)
    out = base
    for name in names:
        fn, dropped = registry[name]
        extra = fn(df)
        added = [c for c in extra.columns if c not in spec.keys and c not in out.columns]
        out = out.join(extra.select(*spec.keys, *added), spec.keys).drop(*dropped)
    return out
