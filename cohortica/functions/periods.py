"""YYYYMM period arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordinal(period: str | Column) -> Column:
    """Months since year 0 of a YYYYMM integer."""
    p = as_col(period).cast("int")
    return (F.floor(p / F.lit(100)) * 12 + F.pmod(p, F.lit(100)) - 1).cast("int")


def ordinal_of(period: int) -> int:
    return (period // 100) * 12 + period % 100 - 1


def month_index(period: str | Column, base: int) -> Column:
    """Months since ``base``."""
    return ordinal(period) - F.lit(ordinal_of(base))


def time_decay(period: str | Column, newest: str | Column, half_life: float) -> Column:
    """Weight 1 at the newest period, halving every ``half_life`` months."""
    if half_life <= 0:
        raise ValueError("half_life must be positive")
    return F.pow(F.lit(0.5), (ordinal(newest) - ordinal(period)) / F.lit(float(half_life)))


def in_recent_window(period: str | Column, through: int, months: int) -> Column:
    """The last ``months`` months up to and including ``through``."""
    cut = ordinal_of(through)
    return (ordinal(period) <= cut) & (ordinal(period) > cut - months)
