"""Data contracts: each returns violation counts; ``enforce`` raises on any."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohortica.spec import DEFAULT, PanelSpec


class ContractViolation(ValueError):
    """A table breaks a contract."""


def enforce(counts: DataFrame) -> dict[str, int]:
    """Raise if any column of a one-row violation table is above zero."""
    row = counts.first().asDict()
    broken = {k: v for k, v in row.items() if v}
    if broken:
        raise ContractViolation(f"contract violations: {broken}")
    return row


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))


def schema_parity(train: DataFrame, score: DataFrame, spec: PanelSpec = DEFAULT) -> list[str]:
    """Problems in the column layout of a labelled and a score table (V1). Reads no data."""
    problems = []
    for name, df, needed in (("train", train, [*spec.keys, spec.label]), ("score", score, spec.keys)):
        missing = [c for c in needed if c not in df.columns]
        if missing:
            problems.append(f"{name} lacks columns {missing}")
    if spec.label in score.columns:
        problems.append(f"score table must not contain {spec.label}")
    if [c for c in train.columns if c != spec.label] != list(score.columns):
        problems.append("train and score columns differ in name or order")
    return problems


def _missing(df: DataFrame, field: T.StructField) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_values(*tables: DataFrame) -> DataFrame:
    """NULL or NaN cells over all tables, one pass per table (V2)."""
    parts = [df.agg(sum((count_if(_missing(df, f)) for f in df.schema.fields), F.lit(0))
                    .cast("long").alias("missing")) for df in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.sum("missing").alias("missing"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key (V3)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def binary_label(df: DataFrame, label: str) -> DataFrame:
    """Labels outside {0, 1}, and whether a class is missing (V4)."""
    y = F.col(label)
    if isinstance(df.schema[label].dataType, T.BooleanType):
        y = y.cast("int")
    return df.agg(
        count_if(y.isNotNull() & (y != 0) & (y != 1)).alias("invalid_labels"),
        (count_if(y == 0) == 0).cast("long").alias("no_negatives"),
        (count_if(y == 1) == 0).cast("long").alias("no_positives"))


def temporal_order(train: DataFrame, score: DataFrame, period: str) -> DataFrame:
    """Score periods not after every labelled period, and malformed periods (V5)."""
    month = F.pmod(F.col(period), F.lit(100))
    bad = count_if(~month.between(1, 12))
    a = train.agg(F.max(period).alias("last_train"), bad.alias("bad_a"), F.count(F.lit(1)).alias("n_a"))
    b = score.agg(F.min(period).alias("first_score"), bad.alias("bad_b"), F.count(F.lit(1)).alias("n_b"))
    return a.crossJoin(b).select(
        (F.col("last_train") >= F.col("first_score")).cast("long").alias("overlap"),
        (F.col("bad_a") + F.col("bad_b")).alias("malformed_periods"),
        ((F.col("n_a") == 0) | (F.col("n_b") == 0)).cast("long").alias("empty_table"))


def absorbing_event(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Second events of an entity and rows after its event (V6).

    Two map-side-combined aggregates instead of a row window.
    """
    per = df.groupBy(spec.entity).agg(
        F.sum(spec.label).alias("_events"), F.min(F.when(F.col(spec.label) == 1, F.col(spec.period))).alias("_at"))
    later = df.join(per, spec.entity).where(F.col(spec.period) > F.col("_at"))
    return per.agg(count_if(F.col("_events") > 1).alias("repeated_events")).crossJoin(
        later.agg(F.count(F.lit(1)).alias("rows_after_event")))


def converted_in_score(train: DataFrame, score: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Score-table rows whose entity already had its event (V6)."""
    done = train.where(F.col(spec.label) == 1).select(spec.entity).distinct()
    return score.join(done, spec.entity, "left_semi").agg(F.count(F.lit(1)).alias("already_converted"))


def seen_report(train: DataFrame, score: DataFrame, entity: str) -> DataFrame:
    """Score rows with a known and an unknown entity (V7)."""
    known = train.select(entity).distinct().withColumn("_known", F.lit(True))
    return score.join(known, entity, "left").agg(
        F.count(F.lit(1)).alias("n_rows"), count_if(F.col("_known").isNotNull()).alias("seen_rows"),
        count_if(F.col("_known").isNull()).alias("unseen_rows"))


def submission_check(submission: DataFrame, reference: DataFrame, row_ord: str = "row_ord",
                     spec: PanelSpec = DEFAULT) -> DataFrame:
    """Row count, same id at the same position, numeric finite score in [0, 1] (V8, V9).

    Position is the ``row_ord`` column both tables carry; scores may be strings.
    """
    extra = [c for c in submission.columns if c not in (row_ord, spec.entity, spec.score)]
    if extra or not {spec.entity, spec.score} <= set(submission.columns):
        raise ContractViolation(f"a submission has exactly {spec.entity}, {spec.score}")
    p = F.expr(f"try_cast(`{spec.score}` as double)")
    left = submission.select(row_ord, F.col(spec.entity).alias("_id"), p.alias("_p"), F.lit(1).alias("_s"))
    right = reference.select(row_ord, F.col(spec.entity).alias("_ref"), F.lit(1).alias("_r"))
    both = left.join(right, row_ord, "full_outer")
    present = F.col("_s").isNotNull()
    return both.agg(
        count_if(F.col("_s").isNull()).alias("missing_rows"),
        count_if(F.col("_r").isNull()).alias("extra_rows"),
        count_if(present & F.col("_r").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_ref"))).alias("id_mismatches"),
        count_if(present & F.col("_p").isNull()).alias("non_numeric"),
        count_if(F.isnan("_p") | (F.abs(F.col("_p")) == F.lit(float("inf")))).alias("non_finite"),
        count_if(~F.isnan("_p") & ((F.col("_p") < 0) | (F.col("_p") > 1))).alias("out_of_range"))


def probability_coverage(expected: DataFrame, predictions: DataFrame, keys: Sequence[str],
                         score: str) -> DataFrame:
    """Exactly one finite probability per expected row.

    Both tables are counted by key first, so repeated predictions are reported and
    never multiplied. Expected keys that repeat count once.
    """
    p = F.col(score)
    bad = p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    tagged = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_q"), F.lit(0).alias("_bad")).unionByName(
        predictions.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_q"), bad.cast("int").alias("_bad")))
    per = tagged.groupBy(*keys).agg(F.max("_e").alias("_e"), F.sum("_q").alias("_q"), F.sum("_bad").alias("_bad"))
    return per.agg(
        count_if(F.col("_q") == 0).alias("missing_predictions"),
        count_if(F.col("_e") == 0).alias("unexpected_predictions"),
        F.coalesce(F.sum(F.greatest(F.col("_q") - 1, F.lit(0))), F.lit(0).cast("long")).alias("duplicate_predictions"),
        F.coalesce(F.sum("_bad"), F.lit(0).cast("long")).alias("invalid_probabilities"))


def row_set_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of each table missing from the other, duplicates counted.

    One aggregate with signed counts replaces two set differences.
    """
    signed = left.select(*columns, F.lit(1).alias("_d")).unionByName(
        right.select(*columns, F.lit(-1).alias("_d")))
    net = signed.groupBy(*columns).agg(F.sum("_d").alias("_d"))
    return net.agg(F.coalesce(F.sum(F.greatest(F.col("_d"), F.lit(0))), F.lit(0)).alias("only_left"),
                   F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("only_right"))


def check_causal(feature_fn: Callable[[DataFrame], DataFrame], df: DataFrame,
                 cuts: Sequence[int], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Feature rows that change when later periods are removed."""
    full = feature_fn(df)
    out = None
    for cut in cuts:
        seen = full.where(F.col(spec.period) <= cut)
        again = feature_fn(df.where(F.col(spec.period) <= cut))
        part = row_set_difference(seen, again, full.columns).select(
            F.lit(cut).alias("cut"), (F.col("only_left") + F.col("only_right")).alias("changed_rows"))
        out = part if out is None else out.unionByName(part)
    return out


def reproduction(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], value: str,
                 tolerance: float) -> DataFrame:
    """Largest difference of recomputed and stored values, and rows beyond tolerance."""
    both = stored.select(*keys, F.col(value).alias("_a")).join(
        recomputed.select(*keys, F.col(value).alias("_b")), list(keys), "full_outer")
    diff = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.max(diff).alias("max_abs_diff"),
                    count_if(diff.isNull() | (diff > tolerance)).alias("beyond_tolerance"))


def prediction_audit(expected: DataFrame, predictions: DataFrame, run: str, keys: Sequence[str],
                     score: str) -> DataFrame:
    """Per run: rows, missing, unexpected and repeated rows, invalid probabilities.

    Each stored row meets its expected row once; what is missing follows from the
    number of expected rows, so expected rows are never multiplied by the runs.
    """
    p = F.col(score)
    bad = p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    got = predictions.groupBy(run, *keys).agg(F.count(F.lit(1)).alias("_rows"), count_if(bad).alias("_bad"))
    want = expected.select(*keys).distinct()
    total = want.agg(F.count(F.lit(1)).alias("_expected"))
    matched = F.col("_e").isNotNull()
    per = got.join(want.withColumn("_e", F.lit(1)), list(keys), "left").groupBy(run).agg(
        F.sum("_rows").alias("n_rows"), count_if(matched).alias("_matched"),
        count_if(~matched).alias("unexpected_rows"), F.sum(F.col("_rows") - 1).alias("duplicate_rows"),
        F.sum("_bad").alias("invalid"))
    return per.crossJoin(F.broadcast(total)).select(
        run, "n_rows", (F.col("_expected") - F.col("_matched")).alias("missing_rows"), "unexpected_rows",
        "duplicate_rows", "invalid")


def metric_audit(predictions: DataFrame, stored: DataFrame, run: str, period: str, score: str, label: str,
                 tolerance: float = 1e-9) -> DataFrame:
    """Per run: stored period Ginis that the stored predictions do not give again.

    ``stored`` has (run, period, gini). A value that only one side has counts as well.
    """
    from cohortica.operators.metrics import auc_table
    again = auc_table(predictions, [run, period], score, label).select(run, period, F.col("gini").alias("_again"))
    both = stored.select(run, period, F.col("gini").alias("_stored")).join(again, [run, period], "full_outer")
    gap = F.abs(F.col("_stored") - F.col("_again"))
    return both.groupBy(run).agg(F.count(F.lit(1)).alias("n_periods"), F.max(gap).alias("max_abs_diff"),
                                 count_if(gap.isNull() | (gap > tolerance)).alias("not_reproduced"))


def layout_problems(train: DataFrame, score: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The problems of ``schema_parity`` as rows (V1)."""
    return train.sparkSession.createDataFrame([(p,) for p in schema_parity(train, score, spec)], "problem string")


def plausibility(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Share of rows on which each rule is true."""
    return df.agg(*[F.avg(rule.cast("int")).alias(name) for name, rule in rules.items()])


def validate_panel(train: DataFrame, score: DataFrame, spec: PanelSpec = DEFAULT) -> dict[str, int]:
    """Every panel contract in turn; returns the report or raises (V1-V7)."""
    problems = schema_parity(train, score, spec)
    if problems:
        raise ContractViolation("; ".join(problems))
    enforce(missing_values(train, score))
    enforce(duplicate_keys(train, spec.keys))
    enforce(duplicate_keys(score, spec.keys))
    enforce(binary_label(train, spec.label))
    enforce(temporal_order(train, score, spec.period))
    enforce(absorbing_event(train, spec))
    return seen_report(train, score, spec.entity).first().asDict()


def running_event_violations(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rows preceded by an event of the same entity; the risk-set form of V6."""
    w = Window.partitionBy(spec.entity).orderBy(spec.period).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_prior", F.sum(spec.label).over(w)).where(F.col("_prior") > 0).agg(
        F.count(F.lit(1)).alias("rows_after_event"))
