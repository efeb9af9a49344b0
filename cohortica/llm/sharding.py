"""Sharding by sampled splitters (operator 6).

Records are ordered by a hash of the text, so equal texts are neighbours. A sample in
which a row's chance grows with its size gives quantile boundaries for many fine ranges
per shard. Exact sizes of all fine ranges then decide: ranges that came out overfull are
sampled again and subdivided, a single text whose copies outweigh half a shard is
subdivided by ``doc_id``, a range of more than ``rows_per_range`` rows is numbered in parts (a
million copies of an empty text weigh little and yet fill a task), and runs of neighbouring ranges of near equal bytes become the
shards. Only range totals (a bounded number) reach the driver; texts are read once and
rows move once, without their text.

A null text is empty (size 16). Null ids and repeated rows are placed like any others.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortica.llm.common import kept, range_index

RANGES_PER_SHARD = 64
ROWS_PER_RANGE = 1_000_000      # more ranges are cut when the rows need them
SAMPLES_PER_RANGE = 8           # expected keys drawn for each fine range
FULL = 2.0                      # a range above this share of its target is subdivided
GROUP_SHARE = 0.5               # copies of one text stay together up to this share of a shard
ROUNDS = 6


def _draw(rows: DataFrame, step: float, seed: int) -> list[tuple[int, float]]:
    """Size-weighted key sample: a row is drawn with probability size/step, and stands for max(size, step)."""
    u = F.pmod(F.xxhash64("key", "doc_id", "size", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    hit = rows.where(u * F.lit(step) < F.col("size")).select("key", F.greatest("size", F.lit(step)).alias("w"))
    return sorted((r["key"], r["w"]) for r in hit.collect())   # about total / step rows


def splitters(sample: list[tuple[int, float]], target: float) -> set[int]:
    """Quantile boundaries; a key that outweighs a range is given one of its own."""
    weight: dict[int, float] = {}
    for key, w in sample:
        weight[key] = weight.get(key, 0.0) + w
    bounds, filled = set(), 0.0
    for key in sorted(weight):
        if weight[key] >= target:
            bounds |= {key, key + 1}
            filled = 0.0
        elif filled + weight[key] > target:
            bounds.add(key)
            filled = weight[key]
        else:
            filled += weight[key]
    return {b for b in bounds if b < 2**63}


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
          seed: int = 17, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row (law ``bytes``)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = kept(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")), "sizes")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(shards * RANGES_PER_SHARD, -(-count // rows_per_range))
    target = max(total / ranges, 1.0)
    bounds = splitters(_draw(rows, target / SAMPLES_PER_RANGE, seed), target)
    for turn in range(ROUNDS):
        cut = sorted(bounds)
        placed = rows.withColumn("fine", range_index(F.col("key"), cut))
        sized = sorted(placed.groupBy("fine").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last")).collect())
        over = [r for r in sized if r["bytes"] > FULL * target]
        mixed = [r["fine"] for r in over if r["first"] != r["last"]]
        if not mixed:
            break
        inside = placed.where(F.col("fine").isin(mixed))
        before = len(bounds)
        bounds |= splitters(_draw(inside, target / SAMPLES_PER_RANGE / 4, seed + turn + 1), target / 2)
        if len(bounds) == before:
            break
    sub, together = F.lit(0), set()
    for r in sized:
        one = r["first"] == r["last"]
        split = one and r["bytes"] > GROUP_SHARE * total / shards        # a text that must span shards
        parts = max(-(-r["bytes"] // int(target)) if split else 1, -(-r["n"] // rows_per_range))
        if parts > 1:                                                    # also many short rows, which bytes do not show
            salt = F.xxhash64("doc_id") if one else F.xxhash64("key", F.lit(seed))
            sub = F.when(F.col("fine") == r["fine"], F.pmod(salt, F.lit(parts)).cast("int")).otherwise(sub)
            if not split:
                together.add(r["fine"])
    placed = placed.withColumn("sub", sub)
    units, filled, slot, place = [], 0, {}, {}
    for r in sized:                                                      # the middle of a range that stays together
        place[r["fine"]] = min(shards - 1, int((filled + r["bytes"] / 2) * shards / total))
        filled += r["bytes"]
    filled = 0
    for r in sorted(placed.groupBy("fine", "sub").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()):
        to = place[r["fine"]] if r["fine"] in together else min(shards - 1, int((filled + r["bytes"] / 2) * shards / total))
        units.append((r["fine"], r["sub"], to, slot.get(to, 0)))
        filled += r["bytes"]
        slot[to] = slot.get(to, 0) + r["n"]
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(units, "fine int, sub int, shard int, base long"))   # one row a range
    in_range = Window.partitionBy("fine", "sub").orderBy("key", "doc_id", "size")
    return placed.join(plan, ["fine", "sub"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.row_number().over(in_range) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op6_sampled_splitter_shards(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
