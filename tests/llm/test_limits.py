"""Limits and counters that must not depend on the size of the input."""

import numpy as np
from pyspark.sql import functions as F

from cohortica.llm import sketch
from cohortica.llm.quality import quality
from cohortica.llm.sharding import shard


def test_a_passage_is_common_in_large_and_small_hosts_alike(spark):
    """The same passage in 30 documents of a small and of a large host goes from both; one in 20 stays."""
    name = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")          # digits count as one
    own = F.concat_ws(" ", *[F.concat(F.lit(f"{chr(97 + k)}x"), name) for k in range(25)])
    passage, rare = (F.lit(" ".join(f"{word}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))) for word in ("common", "seldom"))
    rows = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 60, "small").otherwise("large").alias("source"),
        F.when((F.col("id") < 30) | F.col("id").between(100, 129), F.concat(own, F.lit("\n"), passage))
        .when(F.col("id").between(200, 219), F.concat(own, F.lit("\n"), rare)).otherwise(own).alias("text"))
    out = quality(rows, max_docs=20)
    rejected = {r.doc_id for r in out.where("not kept").select("doc_id").collect()}
    assert rejected == set(range(30)) | set(range(100, 130))
    assert out.where("removed_lines > 0").count() == 60


def test_sums_of_cells_pass_32_bits(spark):
    """Three tasks whose cells are near the limit of their own type."""
    near, kinds = np.int32(2**31 - 5), {0: (np.dtype(np.int32), "sum"), 64: (np.dtype(np.int32), "max")}
    cells, most = np.zeros(128, np.int32), np.zeros(128, np.int32)
    cells[[0, 77]], most[3] = near, 9

    def tables(batches):
        for _ in batches:
            pass
        for first, table in ((0, cells), (64, most)):
            yield from sketch.emit(table, first)

    rows = spark.range(0, 3, 1, 3).mapInArrow(tables, sketch.FIELDS)
    out = sketch.merge(rows, kinds, {0: 128, 64: 128})
    assert out[0][0] == out[0][77] == 3 * int(near) and out[0].dtype == np.int64
    assert out[64][3] == 9 and out[64].dtype == np.int32


def test_many_short_rows_are_numbered_in_parts(spark):
    """20,000 empty texts stay in one shard and are numbered by several tasks; slots have no gap."""
    long = F.concat(F.repeat(F.lit("text "), 400), F.col("id").cast("string"))
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20_000, "").otherwise(long).alias("text"))
    out = shard(docs, 8, rows_per_range=1_000)
    assert "sub" in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    slots, load = {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r.doc_id < 20_000}) == 1 and max(load.values()) < 1.5 * sum(load.values()) / 8
