"""Key joins with their contracts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohortica.functions.ordered import safe_corr
from cohortica.operators.contracts import ContractViolation, count_if
from cohortica.spec import DEFAULT, PanelSpec


def first_event(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The event period of every entity that has one."""
    return df.where(F.col(spec.label) == 1).groupBy(spec.entity).agg(
        F.min(spec.period).alias("event_period"))


def with_event_period(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Every row with its entity's event period or NULL."""
    return df.join(first_event(df, spec), spec.entity, "left")


def with_membership(df: DataFrame, members: DataFrame, key: str, out: str = "is_member") -> DataFrame:
    """Flag rows whose key occurs in another table."""
    known = members.select(key).distinct().withColumn(out, F.lit(True))
    return df.join(known, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def key_report(tables: Sequence[DataFrame], keys: Sequence[str], label: str | None = None) -> DataFrame:
    """One row: keys in all tables, and by table the keys it lacks and repeats; keys whose labels differ.

    The tables are tagged, stacked and grouped by key once, whatever their number.
    """
    none = F.lit(None).cast("double")
    tagged = [t.select(*keys, *[F.lit(int(i == j)).alias(f"_n{j}") for j in range(len(tables))],
                       (F.col(label).cast("double") if label in t.columns else none).alias("_y"),
                       F.lit(int(label in t.columns)).alias("_has"),
                       (F.col(label).isNull().cast("int") if label in t.columns else F.lit(0)).alias("_null"))
              for i, t in enumerate(tables)]
    per = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(
        *[F.sum(f"_n{j}").alias(f"_n{j}") for j in range(len(tables))], F.min("_y").alias("_low"), F.max("_y").alias("_high"),
        F.sum("_has").alias("_has"), F.sum("_null").alias("_null"))
    mixed = (F.col("_low") != F.col("_high")) | ((F.col("_null") > 0) & (F.col("_null") < F.col("_has")))
    return per.agg(
        F.count(F.lit(1)).alias("n_keys"), count_if(mixed).alias("label_differences"),
        *[count_if(F.col(f"_n{j}") == 0).alias(f"lacks_{j}") for j in range(len(tables))],
        *[F.coalesce(F.sum(F.greatest(F.col(f"_n{j}") - 1, F.lit(0))), F.lit(0)).alias(f"repeats_{j}")
          for j in range(len(tables))])


def strict_join(tables: Sequence[DataFrame], spec: PanelSpec = DEFAULT, check: bool = True) -> DataFrame:
    """Tables side by side, one row per key.

    Value columns must be distinct. With ``check`` one pass over the keys of all tables
    proves that each holds every key once and that their labels agree.
    """
    if not tables:
        raise ValueError("at least one table is required")
    shared = {*spec.keys, spec.label}
    values = [c for t in tables for c in t.columns if c not in shared]
    twice = sorted({c for c in values if values.count(c) > 1})
    if twice:
        raise ContractViolation(f"more than one table brings {twice}")
    if check:
        found = {k: v for k, v in key_report(tables, spec.keys, spec.label).first().asDict().items()
                 if v and k != "n_keys"}
        if found:
            raise ContractViolation(f"tables do not match one to one: {found}")
    joined = tables[0]
    for t in tables[1:]:
        joined = joined.join(t.drop(spec.label) if spec.label in joined.columns else t, spec.keys)
    return joined


def strict_join_report(left: DataFrame, right: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Violations of a one-to-one join: unmatched and repeated keys, differing labels.

    A label that is NULL on one side only differs. Repeated keys are counted, never multiplied.
    """
    return key_report([left, right], spec.keys, spec.label).select(
        F.col("n_keys").alias("n_rows"), F.col("lacks_1").alias("unmatched_left"), F.col("lacks_0").alias("unmatched_right"),
        F.col("repeats_0").alias("duplicates_left"), F.col("repeats_1").alias("duplicates_right"), "label_differences")


def align_members(members: Sequence[DataFrame], reference: DataFrame, key: str,
                  row_ord: str = "row_ord", check: bool = True) -> DataFrame:
    """Several score tables in the reference's row order, matched by id and never by position.

    A missing, unexpected or repeated id in any table raises; all tables are checked in one pass.
    """
    if check:
        found = key_report([reference, *members], [key]).first().asDict()
        problems = {}
        for i in range(1, len(members) + 1):
            if found[f"repeats_{i}"]:
                problems[i - 1] = f"{found[f'repeats_{i}']} duplicate ids"
            elif found[f"lacks_{i}"] or found["lacks_0"]:
                problems[i - 1] = f"missing ids: {found[f"lacks_{i}"]}, unexpected ids: {found["lacks_0"]}"
        if problems:
            raise ContractViolation(f"members do not fit the reference: {problems}")
    return reduce(lambda left, m: left.join(m, key), members, reference.select(key, row_ord))


def align_to(values: DataFrame, reference: DataFrame, key: str, row_ord: str = "row_ord",
             check: bool = True) -> DataFrame:
    """One score table in the reference's row order."""
    return align_members([values], reference, key, row_ord, check)


def period_pairs(df: DataFrame, value: str, first: int, second: int,
                 spec: PanelSpec = DEFAULT) -> DataFrame:
    """Equality share and correlation of a value in two periods of the same entity.

    One aggregate per entity instead of a self join.
    """
    p = F.col(spec.period)
    both = df.where(p.isin(first, second)).groupBy(spec.entity).agg(
        F.max(F.when(p == first, F.col(value))).alias("_a"),
        F.max(F.when(p == second, F.col(value))).alias("_b"),
    ).where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n_entities"),
                    F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("same_share"),
                    safe_corr("_a", "_b").alias("correlation"))


def risk_set(intervals: DataFrame, times: DataFrame, time: str = "event_time") -> DataFrame:
    """Rows at risk at each time: ``start < t <= stop``.

    The interval is expanded to the integer times it covers and joined by
    equality. A unit-length interval expands to itself.
    """
    covered = intervals.withColumn(time, F.explode(F.sequence(F.col("start") + 1, F.col("stop"))))
    return covered.join(times.select(time).distinct(), time)
