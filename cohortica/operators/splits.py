"""Temporal splits, hash folds, sampling and perturbation.

Folds are rows of a small cut table joined to the panel, not copies of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cohortica.functions.hashing import entity_bucket, hash_hex, hash_int, hash_uniform
from cohortica.functions.ordered import row_numbers
from cohortica.functions.periods import ordinal, ordinal_of
from cohortica.functions.selection import smallest_cuts
from cohortica.functions.stored import stored
from cohortica.spec import DEFAULT, PanelSpec


def periods(df: DataFrame, spec: PanelSpec = DEFAULT) -> list[int]:
    """Sorted distinct periods; a few hundred values at most."""
    return sorted(r[0] for r in df.select(spec.period).distinct().collect())


def outer_cuts(months: Sequence[int]) -> dict[int, str]:
    """Last two periods validate, the rest trains."""
    if len(months) < 3:
        raise ValueError("the temporal holdout needs at least three periods")
    ordered = sorted(months)
    return {m: ("valid" if m in ordered[-2:] else "train") for m in ordered}


def inner_cuts(months: Sequence[int], folds: int = 4, end: int | None = None) -> list[tuple[int, int]]:
    """``(train_through, valid)`` for the last ``folds`` periods up to ``end``."""
    ordered = sorted(m for m in months if end is None or m <= end)
    if len(ordered) < folds + 1:
        raise ValueError(f"inner folds need at least {folds + 1} periods")
    return [(ordered[i - 1], ordered[i]) for i in range(len(ordered) - folds, len(ordered))]


def outer_holdout(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Role of every row in the outer split (S1); an error below three periods."""
    roles = outer_cuts(periods(df, spec))
    valid = [p for p, role in roles.items() if role == "valid"]
    return df.select(spec.period, *[c for c in df.columns if c != spec.period],
                     F.when(F.col(spec.period).isin(valid), "valid").otherwise("train").alias("role"))


def assign_folds(df: DataFrame, cuts: Sequence[tuple[int, int]], window: int | None = None,
                 spec: PanelSpec = DEFAULT) -> DataFrame:
    """Long ``(fold, role, row)`` assignment for walk-forward cuts.

    ``window`` keeps only the last months of each training part. Rows outside
    every cut are dropped; a row appears once per fold it belongs to.
    """
    options = []
    for through, valid in cuts:
        p = F.col(spec.period)
        train = p <= through
        if window is not None:
            train = train & (ordinal(p) > ordinal_of(through) - window)
        options.append(F.when(p == valid, F.struct(F.lit(valid).alias("fold"), F.lit("valid").alias("role")))
                       .when(train, F.struct(F.lit(valid).alias("fold"), F.lit("train").alias("role"))))
    return df.withColumn("_a", F.explode(F.filter(F.array(*options), lambda s: s.isNotNull()))).select(
        *df.columns, "_a.fold", "_a.role")


def inner_folds(df: DataFrame, folds: int = 4, end: int | None = None,
                spec: PanelSpec = DEFAULT) -> DataFrame:
    """Walk-forward assignment over the last ``folds`` periods found in the data."""
    return assign_folds(df, inner_cuts(periods(df, spec), folds, end), spec=spec)


def fold_counts(assigned: DataFrame, label: str | None = None) -> DataFrame:
    """Rows per fold and role."""
    extra = [F.sum(label).alias("events")] if label else []
    return assigned.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), *extra)


def entity_holdout(df: DataFrame, valid_period: int, buckets: int = 5, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Held-out fifth of the entities: earlier rows of the others train, their month validates.

    An error if either side has no row.
    """
    held = entity_bucket(spec.entity, buckets) == 0
    p = F.col(spec.period)
    role = F.when(held & (p == valid_period), "valid").when(~held & (p < valid_period), "train")
    out = df.withColumn("role", role).where(F.col("role").isNotNull())
    found = {r["role"] for r in out.groupBy("role").count().collect()}
    if found != {"train", "valid"}:
        raise ValueError(f"the entity holdout has no {sorted({'train', 'valid'} - found)} rows")
    return out


def hash_folds(df: DataFrame, folds: int, by: Sequence[str], seed: int = 0) -> DataFrame:
    """Random folds by row key, or grouped folds when ``by`` is the entity."""
    return df.withColumn("fold", F.pmod(hash_int(seed, *by), F.lit(folds)).cast("int"))


def period_quotas(counts: DataFrame, n: int, method: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rows to draw per period, at least one each, in proportion to the period's weight.

    Every period gets the whole part of its share. Rows still missing go one each to the
    largest remainders. Where the minimum of one row gave out too many, rows are taken back
    in the order of how far a period would stay above its share. ``counts`` has one row per
    period; everything is computed on that table.
    """
    if method not in ("balanced-by-month", "recency-aware"):
        raise ValueError(f"unknown sampling method {method}")
    table = Window.partitionBy(F.lit(0))                       # one row per period
    place = F.row_number().over(table.orderBy(spec.period)) - 1
    last = F.greatest(F.count(F.lit(1)).over(table) - 1, F.lit(1))
    weight = F.lit(1.0) if method == "balanced-by-month" else 1.0 + place / last
    rows = counts.select(spec.period, "n_rows", weight.alias("_w"))
    rows = rows.withColumn("_share", F.col("_w") / F.sum("_w").over(table) * F.lit(n))
    rows = rows.withColumn("_whole", F.greatest(F.floor("_share"), F.lit(1)))
    rows = rows.withColumn("_rest", F.col("_share") - F.col("_whole")).withColumn(
        "_open", F.lit(n) - F.sum("_whole").over(table))
    # A row to give is one step up; rows to take back are the steps down to one row.
    down = F.sequence(F.lit(0), F.least(F.col("_whole") - 2, -F.col("_open") - 1))
    steps = (F.when(F.col("_open") > 0, F.array(F.struct(-F.col("_rest"), F.lit(1).alias("step"))))
             .when((F.col("_open") < 0) & (F.col("_whole") > 1),
                   F.transform(down, lambda k: F.struct(F.col("_rest") + k, F.lit(-1).alias("step")))))
    moves = rows.select(spec.period, F.abs("_open").alias("_moves"), F.explode(steps).alias("_s")).select(
        spec.period, "_moves", F.col("_s.col1").alias("_order"), "_s.step")
    moves = moves.withColumn("_at", F.row_number().over(table.orderBy("_order", spec.period)))
    moved = moves.where(F.col("_at") <= F.col("_moves")).groupBy(spec.period).agg(F.sum("step").alias("_step"))
    quota = F.least(F.col("_whole") + F.coalesce("_step", F.lit(0)), F.col("n_rows"))
    return rows.join(moved, spec.period, "left").select(
        F.col(spec.period).cast("int").alias(spec.period), quota.cast("int").alias("quota"))


def stratified_sample(df: DataFrame, n: int, method: str, seed: int,
                      spec: PanelSpec = DEFAULT) -> DataFrame:
    """Exactly ``n`` rows without replacement: ``uniform``, ``balanced-by-month`` or ``recency-aware``.

    The smallest hashes of each period are taken; periods too small for their quota leave a gap
    that the smallest hashes of all other rows fill. Nothing is sorted: the cuts between taken
    and other rows are found by counting (see `smallest_cuts`), and one filter applies them.
    """
    draw = df.withColumn("_u", hash_hex(seed, *spec.keys))
    hashes = stored(draw.select(spec.period, "_u", F.lit(0).alias("_all")), "draws")
    whole = lambda k: df.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(k).alias("wanted"))
    if method == "uniform":
        cut = smallest_cuts(hashes, ["_all"], "_u", whole(n)).select("cut")
        return draw.crossJoin(F.broadcast(cut)).where("_u < cut").select(*df.columns)            # one row
    counts = hashes.groupBy(spec.period).agg(F.count(F.lit(1)).alias("n_rows"))
    quotas = stored(period_quotas(counts, n, method, spec), "quotas")
    cuts = smallest_cuts(hashes, [spec.period], "_u", quotas.select(spec.period, F.col("quota").alias("wanted")))
    taken = draw.join(F.broadcast(cuts), spec.period)                                            # one row a period
    gap = n - (quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])
    if gap <= 0:
        return taken.where("_u < cut").select(*df.columns)
    others = hashes.join(F.broadcast(cuts), spec.period).where("_u >= cut").select("_all", "_u")
    late = smallest_cuts(others, ["_all"], "_u", whole(gap)).select(F.col("cut").alias("late"))
    return taken.crossJoin(F.broadcast(late)).where("_u < cut or _u < late").select(*df.columns)


def entity_subsample(df: DataFrame, fraction: float, seed: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """All rows of the entities whose hash falls below ``fraction`` (S10). No shuffle."""
    return df.where(hash_uniform(seed, spec.entity) < fraction)


def inject_noise(df: DataFrame, column: str, low: int, high: int, draws: int, seed: int,
                 spec: PanelSpec = DEFAULT) -> DataFrame:
    """``draws`` copies of the rows with ``column`` replaced by uniform integers."""
    rows = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    value = F.lit(low) + F.pmod(hash_int(seed, "draw", *spec.keys), F.lit(high - low + 1))
    return rows.withColumn(column, value.cast("int"))


def with_donor(df: DataFrame, columns: Sequence[str], seed: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Every row with a struct ``_donor`` of another row's ``columns``: a permutation within the period."""
    keyed = row_numbers(df, [spec.period], [spec.entity], "_pos")
    donors = df.select(spec.period, F.struct(*columns).alias("_donor"), hash_hex(seed, *spec.keys).alias("_u"))
    donors = row_numbers(donors, [spec.period], ["_u"], "_pos").drop("_u")
    return keyed.join(donors, [spec.period, "_pos"]).drop("_pos")


def permute_within_period(df: DataFrame, column: str, seed: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Shuffle one column inside each period (S12): two orders joined on position."""
    keyed = row_numbers(df, [spec.period], [spec.entity], "_pos")
    donors = df.select(spec.period, F.col(column).alias("_value"), hash_hex(seed, *spec.keys).alias("_u"))
    shuffled = row_numbers(donors, [spec.period], ["_u"], "_pos").drop("_u")
    out = keyed.join(shuffled, [spec.period, "_pos"])
    return out.select(*[F.col("_value").alias(c) if c == column else F.col(c) for c in df.columns])


def redraw_labels(df: DataFrame, probability: str, replicates: int, seed: int,
                  spec: PanelSpec = DEFAULT) -> DataFrame:
    """Labels drawn from the scores themselves, once per replicate."""
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    y = (hash_uniform(seed, "replicate", *spec.keys) < F.col(probability)).cast("int")
    return rows.withColumn(spec.label, y)


def labelled_union(train: DataFrame, score: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Both tables under a ``part`` column, label NULL on the score rows."""
    a = train.withColumn("part", F.lit("train"))
    b = score.withColumn(spec.label, F.lit(None).cast(train.schema[spec.label].dataType)).withColumn(
        "part", F.lit("score"))
    return a.unionByName(b)
