"""Paired entity-cluster bootstrap, multiplicity control and decision rules."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortica.operators.metrics import metric_slices, require_both_classes
from cohortica.operators.replicates import OBSERVED, packed_weights, replicate_pairs, unpacked
from cohortica.session import ensure_checkpoint_dir
from cohortica.spec import DEFAULT, PanelSpec


def leaderboard(table: DataFrame, metric: str, name: str, top: int) -> DataFrame:
    """Best rows of a metric table; ties broken by name."""
    return table.orderBy(F.desc(metric), name).limit(top)


def best_row(table: DataFrame, metric: str, priority: Sequence[str], by: Sequence[str] = (),
             digits: int = 12) -> DataFrame:
    """Highest metric after rounding, then the given priority order (T2); a NULL metric is last.

    An aggregate: candidates are compared where they are, and one row a group moves.
    """
    rank = F.struct(F.coalesce(-F.round(metric, digits), F.lit(float("inf"))).alias("_metric"), *priority)
    row = F.struct(*[F.col(c) for c in table.columns])
    best = (table.groupBy(*by) if by else table).agg(F.min_by(row, rank).alias("_best"))
    return best.where(F.col("_best").isNotNull()).select("_best.*")


def entity_weights(df: DataFrame, replicates: int, seed: int, scheme: str = "multinomial",
                   first: int = 0, spec: PanelSpec = DEFAULT) -> DataFrame:
    """``(replicate, entity, weight)``: how often each entity is drawn (B0), from `packed_weights`."""
    return unpacked(packed_weights(df, replicates, seed, scheme, first, spec), first, spec)


def bootstrap_ginis(long: DataFrame, replicates: int, seed: int, by: Sequence[str] = ("model", "mes"),
                    score: str = "score", scheme: str = "multinomial", first: int = 0,
                    observed: bool = False, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Gini per replicate and key, one shared entity draw per replicate.

    Single-class replicates give NULL; see ``require_both_classes``. ``first`` lets a
    caller run replicates in chunks and append the results. With ``observed`` the
    point estimates come out of the same pass, as replicate ``OBSERVED`` of weight 1.
    """
    rows = long.select(spec.entity, *by, score, spec.label)
    weights = packed_weights(rows, replicates, seed, scheme, first, spec)
    pairs = replicate_pairs(rows, weights, by, score, replicates, observed, first, spec)
    auc = F.try_divide(F.col("pairs"), F.col("pos") * F.col("neg"))
    return pairs.where(F.col("pos") + F.col("neg") > 0).select("replicate", *by, (2 * auc - 1).alias("gini"))


def bootstrap_in_chunks(long: DataFrame, replicates: int, seed: int, chunk: int = 1000,
                        by: Sequence[str] = ("model", "mes"), score: str = "score",
                        scheme: str = "multinomial", spec: PanelSpec = DEFAULT) -> DataFrame:
    """``bootstrap_ginis(observed=True)`` in chunks of replicates, for large tables.

    A row moves with one byte a replicate of the chunk. The Gini rows of a chunk are
    checkpointed, so a failure later repeats nothing that is finished.
    """
    ensure_checkpoint_dir(long.sparkSession)
    rows = long.select(spec.entity, *by, score, spec.label).persist()
    try:
        out = None
        for first in range(0, replicates, chunk):
            size = min(chunk, replicates - first)
            part = bootstrap_ginis(rows, size, seed, by, score, scheme, first, first == 0, spec).checkpoint()
            out = part if out is None else out.unionByName(part)
        return out
    finally:
        rows.unpersist()


def usable_draws(table: DataFrame) -> DataFrame:
    """A bootstrap table without the replicates in which some Gini is undefined, for all models and periods alike.

    Small panels lose a class of some period in a few of many draws; `delta_table` counts the draws that are left.
    The point estimates always stay, so a period that lacks a class in the data is still an error there.
    """
    undefined = table.where(F.col("gini").isNull() & (F.col("replicate") != OBSERVED)).select("replicate").distinct()
    return table.join(undefined, "replicate", "left_anti")


def holm(df: DataFrame, p: str, by: Sequence[str] = (), order: Sequence[str] = (),
         out: str = "p_holm") -> DataFrame:
    """Holm-adjusted p-values of a family (W16); any family size."""
    part = list(by) or [F.lit(0)]
    ranked = Window.partitionBy(*part).orderBy(p, *order)
    family = Window.partitionBy(*part)
    step = (F.count(F.lit(1)).over(family) - F.row_number().over(ranked) + 1) * F.col(p)
    stepped = df.withColumn("_step", F.least(F.lit(1.0), step))
    upto = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.withColumn(out, F.max("_step").over(upto)).drop("_step")


def delta_draws(table: DataFrame, pairs: Sequence[tuple[str, str]], period: str = "mes") -> DataFrame:
    """Paired differences ``(replicate, a, b, period, draw)``, per period and for the period mean.

    ``table`` is (replicate, model, period, gini). The models of one replicate and
    period sit side by side in a map, so no self join is needed.
    """
    side = table.groupBy("replicate", period).agg(
        F.map_from_entries(F.collect_list(F.struct("model", "gini"))).alias("_g"))
    options = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    each = side.select("replicate", period, "_g", F.inline(options)).select(
        "replicate", "a", "b",
        F.explode(F.array(F.col(period).cast("string"), F.lit("mean"))).alias("period"),
        (F.col("_g")[F.col("a")] - F.col("_g")[F.col("b")]).alias("_d"))
    return each.groupBy("replicate", "a", "b", "period").agg(F.avg("_d").alias("draw"))


def delta_table(table: DataFrame, pairs: Sequence[tuple[str, str]], period: str = "mes",
                center: str = "observed", family: Sequence[str] = ()) -> DataFrame:
    """Delta, 95% interval, p-value per pair and period, Holm over the pair means.

    ``table`` comes from ``bootstrap_ginis(observed=True)``. Each output row gathers
    one number per replicate, so its size is the replicate count. A single-class
    draw is an error (see `usable_draws`), so every mean covers all periods and every interval
    the same draws; ``draws`` is their number.
    """
    draws = delta_draws(require_both_classes(table), pairs, period)
    drawn = F.col("replicate") != OBSERVED
    d = F.when(drawn, F.col("draw"))
    rows = draws.groupBy("a", "b", "period").agg(
        F.max(F.when(~drawn, F.col("draw"))).alias("delta"),
        F.percentile(d, F.lit(0.025)).alias("ci_low"), F.percentile(d, F.lit(0.975)).alias("ci_high"),
        F.avg(d).alias("_mean"), F.avg((d > 0).cast("int")).alias("p_positive"),
        F.collect_list(d).alias("_draws"))
    middle = F.col("delta") if center == "observed" else F.col("_mean")
    far = F.size(F.filter("_draws", lambda x: F.round(F.abs(x - middle), 12) >= F.round(F.abs(F.col("delta")), 12)))
    tested = rows.withColumn("p_two_sided", (far + 1) / (F.size("_draws") + 1)).withColumn(
        "draws", F.size("_draws").cast("long")).drop("_draws", "_mean")
    mean_only = F.when(F.col("period") == "mean", F.round("p_two_sided", 12))
    ranked = tested.withColumn("_family", F.col("period") == "mean").withColumn("_p", mean_only)
    adjusted = holm(ranked, "_p", ["_family", *family], ["a", "b", "period"])
    return adjusted.withColumn("p_holm", F.when(F.col("_family"), F.col("p_holm"))).drop("_family", "_p")


def pairs_against(models: Sequence[str], *baselines: str) -> list[tuple[str, str]]:
    """Every other model against each baseline."""
    return [(m, b) for b in baselines for m in models if m != b]


def all_pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    """Every unordered pair."""
    return list(combinations(sorted(models), 2))


def pooled_delta(df: DataFrame, a: str, b: str, replicates: int, seed: int,
                 scheme: str = "multinomial", by: Sequence[str] = (),
                 spec: PanelSpec = DEFAULT) -> DataFrame:
    """Pooled Gini difference with an entity-cluster percentile interval (B1).

    Single-class replicates are skipped; ``bootstrap_replicates`` reports how many were used.
    Fewer than two entities, or no usable replicate, is an error.
    """
    by = list(by)
    if df.select(spec.entity).distinct().limit(2).count() < 2:
        raise ValueError("an entity bootstrap needs at least two entities")
    long = df.unpivot([spec.entity, *by, spec.label], [a, b], "model", "score")
    table = bootstrap_ginis(long, replicates, seed, [*by, "model"], "score", scheme, observed=True, spec=spec)
    per = table.groupBy("replicate", *by).agg(
        (F.max(F.when(F.col("model") == a, F.col("gini")))
         - F.max(F.when(F.col("model") == b, F.col("gini")))).alias("_d"))
    drawn = F.when(F.col("replicate") != OBSERVED, F.col("_d"))
    out = (per.groupBy(*by) if by else per).agg(
        F.max(F.when(F.col("replicate") == OBSERVED, F.col("_d"))).alias("delta_gini"),
        F.percentile(drawn, F.lit(0.025)).alias("ci95_low"), F.percentile(drawn, F.lit(0.975)).alias("ci95_high"),
        F.count(drawn).alias("bootstrap_replicates"))
    usable = F.when(F.col("bootstrap_replicates") == 0, F.raise_error(
        F.lit("no bootstrap draw has both classes")).cast("long")).otherwise(F.col("bootstrap_replicates"))
    return out.withColumn("bootstrap_replicates", usable)


def probability_of_best(table: DataFrame, period: str | None = None) -> DataFrame:
    """Share of replicates in which each model is highest; ties are split."""
    draws = table.where(F.col("replicate") != OBSERVED)
    if period is None:
        values = draws.groupBy("replicate", "model").agg(F.avg("gini").alias("v"))
        keys: list[str] = []
    else:
        values = draws.select("replicate", "model", period, F.col("gini").alias("v"))
        keys = [period]
    within = Window.partitionBy("replicate", *keys)
    win = (F.max("v").over(within) - F.col("v") <= 1e-12).cast("int")
    flagged = values.withColumn("_w", win)
    share = F.col("_w") / F.sum("_w").over(within)
    return flagged.withColumn("_s", share).groupBy(*keys, "model").agg(F.avg("_s").alias("p_best"))


def two_baselines(table: DataFrame, models: Sequence[str], first: str, second: str) -> DataFrame:
    """Mean delta of every candidate against two baselines side by side, Holm per baseline."""
    rows = delta_table(table, pairs_against(models, first, second), family=["b"]).where(F.col("period") == "mean")
    return rows.groupBy(F.col("a").alias("candidate")).agg(*[
        F.max(F.when(F.col("b") == base, F.col(c))).alias(f"{c}_vs_{base}")
        for base in (first, second) for c in ("delta", "ci_low", "ci_high", "p_two_sided", "p_holm")])


def gate(temporal: DataFrame, held_out: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Pass when both intervals are above zero and no cohort loses.

    ``cohorts`` has one ``delta`` per cohort; NULL means the cohort lacks a class.
    """
    worst = cohorts.agg(F.min("delta").alias("_worst"))
    t = temporal.select((F.col("ci95_low") > 0).alias("temporal_ok"))
    g = held_out.select((F.col("ci95_low") > 0).alias("held_out_ok"))
    c = worst.select(F.coalesce(F.col("_worst") >= 0, F.lit(True)).alias("cohorts_ok"))
    return t.crossJoin(g).crossJoin(c).withColumn(
        "passed", F.col("temporal_ok") & F.col("held_out_ok") & F.col("cohorts_ok"))


def winner_status(delta: DataFrame, slices: DataFrame) -> DataFrame:
    """Conclusive when the interval is above zero, every period positive, cohorts not negative."""
    s = slices.agg(
        F.min(F.when(F.col("slice") == "period", F.col("gini"))).alias("_p"),
        F.min(F.when(F.col("slice") == "cohort", F.col("gini"))).alias("_c"))
    ok = (F.col("ci95_low") > 0) & F.coalesce(F.col("_p") > 0, F.lit(True)) & F.coalesce(
        F.col("_c") >= 0, F.lit(True))
    return delta.crossJoin(s).select(
        "delta_gini", "ci95_low",
        F.when(ok, "conclusive_winner").otherwise("no_conclusive_winner").alias("status"))


def finalists(inner: DataFrame) -> tuple[str, str] | None:
    """Champion and runner-up by mean inner-fold Gini, ties by name; None with fewer than two eligible candidates.

    ``inner`` has (model, eligible, mean_gini), one row a candidate, from folds before the holdout.
    """
    best = inner.where("eligible and mean_gini is not null").orderBy(F.desc("mean_gini"), "model").limit(2).collect()
    return (best[0]["model"], best[1]["model"]) if len(best) == 2 else None


def outer_winner(inner: DataFrame, holdout: DataFrame, cohort: str, replicates: int, seed: int,
                 scheme: str = "multinomial", spec: PanelSpec = DEFAULT) -> DataFrame:
    """The finalists, the bootstrap of their difference on the holdout, and the verdict.

    ``holdout`` has one score column a candidate. The holdout plays no part in the choice.
    """
    pair = finalists(inner)
    if pair is None:
        return holdout.sparkSession.range(1).select(
            F.lit(None).cast("string").alias("champion"), F.lit(None).cast("string").alias("runner_up"),
            F.lit(None).cast("double").alias("delta_gini"), F.lit(None).cast("double").alias("ci95_low"),
            F.lit("no_conclusive_winner").alias("status"))
    champion, runner_up = pair
    delta = pooled_delta(holdout, champion, runner_up, replicates, seed, scheme, spec=spec)
    slices = metric_slices(holdout, spec.period, cohort, champion, spec.label, probability=True)
    return winner_status(delta, slices).select(F.lit(champion).alias("champion"), F.lit(runner_up).alias("runner_up"), "*")


def promotion_label(mean_gini: Column, blend_gini: Column, mean_spearman: Column, baseline: float,
                    promote: float = 0.253, competitive: float = 0.251, floor: float = 0.248,
                    max_spearman: float = 0.95) -> Column:
    """Promote, competitive, ensemble-only or reject, from a metric row."""
    return (F.when(mean_gini > promote, "promote").when(mean_gini > competitive, "competitive")
            .when(blend_gini > baseline, "ensemble-only (blend)")
            .when((mean_gini >= floor) & (mean_spearman < max_spearman), "ensemble-only")
            .otherwise("reject"))
