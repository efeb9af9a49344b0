"""Scalar feature expressions: ratios, rule flags, links, cell keys."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, functions as F

from cohortica.functions.periods import as_col, month_index
from cohortica.spec import UNKNOWN_CATEGORY

# Ordinal codes of the risk band.
BAND_ORDER = {"low": 0, "medium": 1, "high": 2}


def behavioural_ratios() -> dict[str, Column]:
    """Guarded ratios of the static columns."""
    tenure = F.col("antiguedad_cuenta_meses")
    products = F.col("numero_productos")
    adult_months = F.greatest(F.lit(12.0) * (F.col("edad") - F.lit(18.0)), F.lit(1.0))
    years = (tenure + F.lit(1.0)) / F.lit(12.0)
    return {
        "saldo_ingresos": F.try_divide("saldo_promedio", "ingresos"),
        "ingreso_neto": F.col("ingresos") * (F.lit(1.0) - F.col("ratio_deuda_ingresos")),
        "antiguedad_share_vida_adulta": tenure / adult_months,
        "productos_por_anio_antiguedad": products / years,
        "visitas_por_producto": F.col("visitas_web_ultimos_90_dias") / F.greatest(products, F.lit(1)),
        "recencia_ratio": F.col("dias_ultima_transaccion") / (tenure + F.lit(1.0)),
    }


def interaction_gap() -> Column:
    return F.abs(F.col("dias_ultima_interaccion") - F.col("dias_ultima_transaccion"))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def rule_flags(tenure: str | Column = "k") -> dict[str, Column]:
    """The twelve hand-written rules."""
    band = F.col("banda_riesgo")
    low, medium, high = band == "low", band == "medium", band == "high"
    days, products = F.col("dias_ultima_transaccion"), F.col("numero_productos")
    year_share = days / F.lit(365.0)
    mobile_card = F.col("activo_movil") & F.col("tiene_tarjeta_credito")
    return {
        "L": _flag(low),
        "H": _flag(high),
        "L_p3": _flag(low & (products >= 3)),
        "L_mc_p2": _flag(low & mobile_card & (products >= 2)),
        "L_dtx": _flag(low) * year_share,
        "H_dtx100": _flag(high & (days < 100)),
        "H_dtx180": _flag(high & (days < 180)),
        "H_old_branch": _flag(high & (days >= 180) & (F.col("canal_adquisicion") == "branch")),
        "M_dtx": _flag(medium) * year_share,
        "k": F.ln(as_col(tenure).cast("double")),
        "LM_debt60": _flag((low | medium) & (F.col("ratio_deuda_ingresos") >= 0.6)),
        "saldo_floor": _flag(F.col("saldo_promedio") <= 300),
    }


def submission_flags() -> dict[str, Column]:
    """The seven submission flags and the two extra ones, as 0/1 integers."""
    low, high = F.col("banda_riesgo") == "low", F.col("banda_riesgo") == "high"
    mobile_card = F.col("activo_movil") & F.col("tiene_tarjeta_credito")
    stale = F.col("dias_ultima_transaccion") > 180
    branch = F.col("canal_adquisicion") == "branch"
    products = F.col("numero_productos")
    rules = {
        "movil_y_tarjeta": mobile_card,
        "riesgo_low_productos_3_o_mas": low & (products >= 3),
        "riesgo_low_movil_tarjeta_2_o_mas": low & (products >= 2) & mobile_card,
        "transaccion_mas_180": stale,
        "riesgo_high_transaccion_mas_180": high & stale,
        "riesgo_high_canal_branch": high & branch,
        "riesgo_high_branch_transaccion_mas_180": high & branch & stale,
        "riesgo_low_deuda_06": low & (F.col("ratio_deuda_ingresos") >= 0.6),
        "riesgo_high_menos_100": high & (F.col("dias_ultima_transaccion") < 100),
    }
    return {name: F.coalesce(rule.cast("int"), F.lit(0)) for name, rule in rules.items()}


def copy_flag(a: str, b: str) -> Column:
    """Whether two columns carry the same value."""
    return F.col(a) == F.col(b)


def known_category(c: str) -> Column:
    """NULL becomes the unknown label."""
    return F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN_CATEGORY))


def pair_keys(columns: Sequence[str]) -> dict[str, Column]:
    """Each category, then every two-way combination ``a__b`` valued ``x|y``."""
    out = {c: known_category(c) for c in columns}
    for a, b in combinations(columns, 2):
        out[f"{a}__{b}"] = F.concat_ws("|", known_category(a), known_category(b))
    return out


def band_ordinal(c: str = "banda_riesgo") -> Column:
    """Low, medium, high as 0, 1, 2 (P5)."""
    mapping = F.create_map(*[x for k, v in BAND_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return mapping[F.col(c)]


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def hazard_probability(eta: Column) -> Column:
    """Complementary log-log link with a clipped exponent."""
    clipped = F.greatest(F.least(eta, F.lit(40.0)), F.lit(-40.0))
    return -F.expm1(-F.exp(clipped))


def right_closed_bin(value: Column, edges: Sequence[float]) -> Column:
    """1-based index of the interval ``(edge[i-1], edge[i]]``; outside is NULL."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        out = F.when((value > edges[i - 1]) & (value <= edges[i]), F.lit(i)).otherwise(out)
    return out


def cell_key() -> Column:
    """Band, capped products, mobile-and-card, recency bin."""
    recency = right_closed_bin(F.col("dias_ultima_transaccion"), [0, 100, 180, 400])
    return F.concat_ws(
        "|", F.col("banda_riesgo"), F.least(F.col("numero_productos"), F.lit(3)).cast("string"),
        (F.col("activo_movil") & F.col("tiene_tarjeta_credito")).cast("string"),
        F.coalesce(recency.cast("string"), F.lit("none")))


def fixed_width_bin(c: str, width: int) -> Column:
    """Lower edge of the bin of the given width."""
    return (F.floor(F.col(c) / F.lit(width)) * width).cast("int")


def capped(c: str | Column, top: int) -> Column:
    return F.least(as_col(c), F.lit(top))


def model_ready(numeric: Sequence[str], boolean: Sequence[str]) -> list[Column]:
    """Numerics as 32-bit floats and booleans as 0/1."""
    return ([F.col(c).cast("float").alias(c) for c in numeric]
            + [F.col(c).cast("int").alias(c) for c in boolean])


def month_columns(encoding: str, period: str = "mes", base: int = 202601) -> dict[str, Column]:
    """The month itself or its index, for the feature matrices with a month."""
    if encoding == "absolute":
        return {"mes_feature": F.col(period)}
    if encoding == "index":
        return {"month_index": month_index(period, base)}
    raise ValueError(f"unknown month encoding {encoding}")
