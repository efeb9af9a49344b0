"""Ordered computations that never put a whole group into one task.

A plain ``Window.partitionBy(period)`` sends one period, possibly a third of the
table, to one task. Everything here works on ranges instead:

1. collapse ties first (map-side combine), so one hot value is one row;
2. ``repartitionByRange(keys, order)``: Spark samples and cuts even ranges, and a
   big group spans many of them; the range number orders them;
3. compute inside each range, then pass only per-range totals on: between few
   ranges directly, between many through a tree of blocks of ranges.

No step depends on two evaluations of the range partitioning agreeing with each
other: the range number is computed once and carried in the rows, which stay one
straight line of the plan or are written once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortica.functions.stored import stored

_SEG = "_range"
_TO = "_to_range"


# Fan-in of the tree over ranges, and the number of ranges that message each other directly.
BLOCK = 64


def range_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_ranges(df: DataFrame, by: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Range-partition by ``by`` and record the range number of every row.

    The explicit number keeps adaptive execution from merging ranges. Range ``i``
    becomes partition ``i``: hashing the range number instead would put several
    ranges into some tasks and none into others.
    """
    n = ranges or range_count(df)
    ranged = df.repartitionByRange(n, *[F.col(c) for c in by])
    return ranged.withColumn(_SEG, F.spark_partition_id()).repartitionById(n, F.col(_SEG))


_Plan = list[tuple[str, str, Callable[[Column | str], Column], str]]


def _combined(f: Callable, a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if f is F.sum else F.greatest(a, b)


def _same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal or both NULL ``on``; the right side's ``on`` columns go."""
    renamed = right.select(*[F.col(c).alias(f"_on_{c}" if c in on else c) for c in right.columns])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(renamed, match, how).drop(*[f"_on_{c}" for c in on])


def prefix_tree(rows: DataFrame, keys: Sequence[str], at: str, aggregates: dict[str, Callable],
                places: int) -> DataFrame:
    """What the rows before each row add up to, by ``at`` within ``keys``: one row per ``(keys, at)``.

    ``aggregates`` maps columns to ``F.sum`` or ``F.max``; ``places`` bounds ``at``. Sums go
    up through blocks of ``BLOCK`` places until one block is left, and prefixes come down again,
    so no window holds more than ``BLOCK`` rows and each level has ``BLOCK`` times fewer of them.
    """
    keys = list(keys)
    before = lambda *by: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    if places <= BLOCK:
        return rows.select(*keys, at, *[f(c).over(before(*keys)).alias(c) for c, f in aggregates.items()])
    block = f"{at}_block"
    blocked = rows.select(*keys, at, F.floor(F.col(at) / BLOCK).cast("int").alias(block), *aggregates)
    inside = blocked.select(*keys, at, block, *[f(c).over(before(*keys, block)).alias(f"_in_{c}") for c, f in aggregates.items()])
    above = prefix_tree(blocked.groupBy(*keys, block).agg(*[f(c).alias(c) for c, f in aggregates.items()]),
                        keys, block, aggregates, -(-places // BLOCK))
    return _same(inside, above, [*keys, block], "left").select(
        *keys, at, *[_combined(f, F.col(f"_in_{c}"), F.col(c)).alias(c) for c, f in aggregates.items()])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            sums: dict[str, str] | None = None, maxes: dict[str, str] | None = None,
            totals: dict[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """Inclusive running sums / maxima over ``order`` within ``keys``, and whole-key totals.

    ``sums``, ``maxes`` and ``totals`` map output name to input column; ``(keys,
    order)`` must be unique. Each range is scanned once. Only the first and the last
    key of a range can reach into other ranges. Up to ``BLOCK`` ranges message each
    other; more of them write their local results once and exchange totals through
    `prefix_tree`, two rows from each range, so nothing grows with pairs of ranges.
    """
    keys, order = list(keys), list(order)
    n = ranges or range_count(df)
    plan: _Plan = [(out, c, F.sum, "run") for out, c in (sums or {}).items()]
    plan += [(out, c, F.max, "run") for out, c in (maxes or {}).items()]
    plan += [(out, c, F.sum, "total") for out, c in (totals or {}).items()]
    ranged = with_ranges(df, keys + order, n)
    in_key = Window.partitionBy(_SEG, *keys).orderBy(*order)
    upto = in_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_range = Window.partitionBy(_SEG).orderBy(*keys, *order)
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    tree = n > BLOCK
    local = ranged.select(
        "*",
        *[f(c).over(upto).alias(f"_run_{out}") for out, c, f, _ in plan],
        F.lead(F.lit(1)).over(in_range).isNull().alias("_ends_range"),
        *([F.lead(F.lit(1)).over(in_key).isNull().alias("_ends_key"),
           F.first(key).over(in_range).eqNullSafe(key).alias("_first_key")] if totals or tree else []))
    offsets = _tree_offsets if tree else _message_offsets
    return offsets(local, df.columns, keys, plan, n)


def _tree_offsets(local: DataFrame, columns: Sequence[str], keys: list[str], plan: _Plan, n: int) -> DataFrame:
    """Running values from those of each range, by the tree over ranges."""
    whole = Window.partitionBy(_SEG, *keys)
    local = stored(local.select("*", *[
        f(c).over(whole).alias(f"_all_{out}") for out, c, f, kind in plan if kind == "total"]), "ranges")
    edges = local.where(F.col("_ends_key") & (F.col("_ends_range") | F.col("_first_key"))).select(
        *keys, _SEG, *[F.col(f"_run_{out}").alias(f"_off_{out}") for out, *_ in plan])
    runs = {f"_off_{out}": f for out, _, f, kind in plan if kind == "run"}
    carry = prefix_tree(edges, keys, _SEG, runs, n) if runs else edges.select(*keys, _SEG)
    sums = [F.sum(f"_off_{out}").alias(f"_off_{out}") for out, _, _, kind in plan if kind == "total"]
    if sums:
        totals = edges.groupBy(*keys).agg(*sums) if keys else edges.agg(*sums)
        carry = _same(carry, totals, keys, "inner") if keys else carry.crossJoin(totals)      # no keys: one row
    carry = stored(carry, "carries")                  # small: its size decides how it is joined
    final = []
    for out, _, f, kind in plan:
        run, off = F.col(f"_run_{out}"), F.col(f"_off_{out}")
        final.append((F.coalesce(off, F.col(f"_all_{out}")) if kind == "total" else _combined(f, run, off)).alias(out))
    return _same(local, carry, [_SEG, *keys], "left").select(*columns, *final)


def _message_offsets(local: DataFrame, columns: Sequence[str], keys: list[str], plan: _Plan, n: int) -> DataFrame:
    """The same for few ranges: the last row of a key sends its value to every range it may reach."""
    none = F.array().cast("array<int>")
    later = F.when(F.col("_ends_range") & (F.col(_SEG) < n - 1),
                   F.sequence(F.col(_SEG) + 1, F.lit(n - 1))).otherwise(none)
    targets = [F.array(F.col(_SEG)), later]
    if any(kind == "total" for *_, kind in plan):
        targets.append(F.when(F.col("_ends_key") & F.col("_first_key") & (F.col(_SEG) > 0),
                              F.sequence(F.lit(0), F.col(_SEG) - 1)).otherwise(none))
    sent = local.withColumn(_TO, F.explode(F.concat(*targets))).repartitionById(n, F.col(_TO))
    at_target = Window.partitionBy(_TO, *keys)
    came, forward = F.col(_TO) != F.col(_SEG), F.col(_TO) > F.col(_SEG)
    offsets, final = [], []
    for out, c, f, kind in plan:
        run, off = F.col(f"_run_{out}"), F.col(f"_off_{out}")
        part = F.when(forward, run) if kind == "run" else F.when(came, run).otherwise(F.col(c))
        offsets.append(f(part).over(at_target).alias(f"_off_{out}"))
        final.append((off if kind == "total" else _combined(f, run, off)).alias(out))
    return sent.select("*", *offsets).where(~came).select(*columns, *final)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                out: str = "row_num") -> DataFrame:
    """1-based position over a unique ``order`` within ``keys``."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running(one, keys, order, sums={out: "_one"}).drop("_one")


def value_counts(df: DataFrame, keys: Sequence[str], value: str, out: str = "n") -> DataFrame:
    return (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias(out)))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct ``(keys, value)``: count, first position, average and percentile rank.

    ``n_before`` is the number of rows with a smaller value.
    """
    keys = list(keys)
    counts = value_counts(df, keys, value, "n")
    cum = running(counts, keys, [value], sums={"n_upto": "n"}, totals={"n_total": "n"})
    avg_rank = F.col("n_upto") - (F.col("n") - 1) / F.lit(2.0)
    return cum.select(
        *keys, value, "n", (F.col("n_upto") - F.col("n")).alias("n_before"), "n_total",
        avg_rank.alias("avg_rank"), (avg_rank / F.col("n_total")).alias("pct_rank"))


def pct_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average-tie percentile rank in (0, 1]; NULL values get NULL and are not counted."""
    return add_ranks(df, keys, {value: out})


def add_ranks(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Percentile ranks of several columns; every rank table comes from ``df`` itself.

    Chaining single ranks would recompute the earlier joins for each later rank.
    """
    out = df
    for value, name in columns.items():
        ranks = value_ranks(df, keys, value).select(*keys, value, F.col("pct_rank").alias(name))
        out = out.join(ranks, [*keys, value], "left")
    return out.select(*df.columns, *columns.values())


_SMALL_TABLE = 100_000        # values of a column whose ranks are broadcast
_JOINED_ROWS = 200_000        # rows of a task that joins more of them


def pct_ranks(df: DataFrame, row_key: Sequence[str], keys: Sequence[str],
              columns: Sequence[str], prefix: str = "rk_", digits: int | None = None) -> DataFrame:
    """Percentile ranks of several columns; their ordered pass is one over the long form of the values.

    Returns ``row_key`` plus one rank column per input column. Wide rows meet the ranks of one column
    after the other: small tables, as counted, go to the rows, so a value that many rows share fills no task;
    for the others the number of tasks grows with the rows. Rows are never regrouped.
    """
    values = F.array(*[F.col(c).cast("double") for c in columns])
    long = df.select(*keys, F.posexplode(values).alias("_column", "_value"))
    rank = F.col("pct_rank") if digits is None else F.round("pct_rank", digits)
    ranks = stored(value_ranks(long, ["_column", *keys], "_value").select("_column", *keys, "_value", "n", rank.alias("_rank")),
                   "ranks", "_column")
    sizes = {r["_column"]: r for r in ranks.groupBy("_column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")).collect()}
    parts = max(range_count(df), -(-max([r["rows"] for r in sizes.values()], default=0) // _JOINED_ROWS))
    many = [i for i, r in sizes.items() if r["values"] > _SMALL_TABLE]
    extra = [k for k in keys if k not in row_key]
    out = df.select(*row_key, *extra, *[F.col(c).cast("double").alias(f"_value_{i}") for i, c in enumerate(columns)])
    for i in sorted(range(len(columns)), key=lambda i: i not in many):
        table = ranks.where(F.col("_column") == i).select(
            *keys, F.col("_value").alias(f"_value_{i}"), F.col("_rank").alias(f"_rank_{i}"))
        on = [*keys, f"_value_{i}"]
        out = (out.repartition(parts, *on).join(table.repartition(parts, *on).hint("merge"), on, "left") if i in many
               else out.join(F.broadcast(table), on, "left"))
    return out.select(*row_key, *[F.col(f"_rank_{i}").alias(f"{prefix}{c}") for i, c in enumerate(columns)])


def quantiles(df: DataFrame, keys: Sequence[str], value: str,
              probs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles, long form ``(keys, prob, quantile)``.

    The built-in ``percentile`` keeps every distinct value of a group in one
    buffer; here each quantile is looked up from the running counts.
    """
    keys = list(keys)
    ranks = value_ranks(df, keys, value)
    at = F.col("prob") * (F.col("n_total") - 1)
    lo, hi = F.floor(at), F.ceil(at)
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    hits = ranks.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    frac = at - lo
    v = F.col(value).cast("double")
    part = (F.when((first <= lo) & (lo <= last), v).alias("_lo"),
            F.when((first <= hi) & (hi <= last), v).alias("_hi"))
    return (hits.select(*keys, "prob", frac.alias("_frac"), *part)
            .where(F.col("_lo").isNotNull() | F.col("_hi").isNotNull())
            .groupBy(*keys, "prob")
            .agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_frac").alias("_frac"))
            .select(*keys, "prob",
                    (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("quantile")))


def quantiles_wide(df: DataFrame, keys: Sequence[str], value: str,
                   probs: dict[str, float]) -> DataFrame:
    """Quantiles as named columns, one row per key."""
    long = quantiles(df, keys, value, list(probs.values()))
    aggs = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name)
            for name, p in probs.items()]
    return long.groupBy(*keys).agg(*aggs) if keys else long.agg(*aggs)


def lookup_positions(positions: DataFrame, reference: DataFrame, keys: Sequence[str],
                     position: str, value: str, out: str) -> DataFrame:
    """Value of the sorted reference at each 0-based position (T5).

    Both sides are merged on the position axis and the largest reference value so
    far is carried forward; a sorted reference never decreases, so that value is
    the one at the position. No range join and no single sorted list is needed.
    """
    keys = list(keys)
    ref = value_ranks(reference, keys, value).select(
        *keys, F.col("n_before").alias("_pos"), F.lit(0).alias("_side"),
        F.col(value).cast("double").alias("_ref"))
    ask = positions.select(*keys, F.col(position).alias("_pos")).distinct().select(
        *keys, "_pos", F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_ref"))
    merged = running(ref.unionByName(ask), keys, ["_pos", "_side"], maxes={out: "_ref"})
    found = merged.where(F.col("_side") == 1).select(
        *keys, F.col("_pos").alias(position), out)
    return positions.join(found, [*keys, position])


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation aggregate; NULL instead of an error when a side is constant."""
    ca, cb = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    x = F.when(cb.isNotNull(), ca.cast("double"))
    y = F.when(ca.isNotNull(), cb.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
