"""Exact selection of the smallest hashes without a sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cohortica.functions.stored import stored

_DIGITS = 3                   # hex digits of a cell: 4,096 cells a round
_ALL = "g"                    # above every hex digit


def smallest_cuts(hashes: DataFrame, keys: Sequence[str], order: str, wanted: DataFrame) -> DataFrame:
    """``(keys, cut)``: in each group the rows with ``order < cut`` are its ``wanted`` smallest.

    ``order`` is a hex text of one length for all rows, unique in its group; ``wanted`` has
    ``(keys, wanted)``, one row a group. Each round counts the rows of a group by the next hex
    digits, finds the cell that holds the cut, and looks only at that cell in the next round. Only
    counts move: a cell has 4,096 times fewer rows than the one before, so three rounds serve
    10^10 rows. A group with fewer rows than wanted is taken whole.
    """
    keys = list(keys)
    state = stored(wanted.select(*keys, F.lit("").alias("_prefix"), F.col("wanted").cast("long").alias("_left")), "cuts")
    cuts = [state.where("_left <= 0").select(*keys, F.lit("").alias("cut"))]
    state, at = state.where("_left > 0"), 1
    upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while not state.isEmpty():
        inside = hashes.join(F.broadcast(state), keys).where(F.col(order).startswith(F.col("_prefix")))     # one row a group
        cells = inside.groupBy(*keys, "_prefix", "_left", F.substring(order, at, _DIGITS).alias("_cell")).agg(
            F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
        cut = cells.where("_upto >= _left").groupBy(*keys).agg(F.min_by(F.struct(
            F.concat("_prefix", "_cell").alias("prefix"), (F.col("_left") - F.col("_upto") + F.col("_n")).alias("left"), "_n"), "_cell").alias("_at"))
        found = stored(state.join(cut, keys, "left"), "cuts")
        whole = F.col("_at").isNull()
        settled = whole | (F.col("_at._n") == F.col("_at.left"))
        cuts.append(found.where(settled).select(*keys, F.when(whole, F.lit(_ALL)).otherwise(
            F.concat("_at.prefix", F.lit(_ALL))).alias("cut")))
        state = found.where(~settled).select(*keys, F.col("_at.prefix").alias("_prefix"), F.col("_at.left").alias("_left"))
        at += _DIGITS
        if at > 64 + _DIGITS and not state.isEmpty():
            raise ValueError(f"{order} is not unique in its group")
    out = cuts[0]
    for part in cuts[1:]:
        out = out.unionByName(part)
    return out
