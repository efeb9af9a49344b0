import random

import pytest

from pyspark.sql import functions as F

from cohortica.functions.selection import smallest_cuts


@pytest.mark.parametrize("shared", [0, 5, 9])
def test_cuts_take_exactly_the_smallest(spark, shared):
    """Groups of very different sizes; hashes that share leading digits need more rounds."""
    rng = random.Random(shared)
    sizes = {"big": 4000, "small": 3, "one": 1, None: 50}
    wanted = {"big": 1234, "small": 10, "one": 1, None: 0, "absent": 5}
    rows = [(g, "0" * shared + f"{rng.getrandbits(64):016x}") for g, n in sizes.items() if g for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, u string").repartition(7)
    ask = spark.createDataFrame([(g, k) for g, k in wanted.items() if g], "g string, wanted int")
    cuts = {r.g: r.cut for r in smallest_cuts(df, ["g"], "u", ask).collect()}
    for g, k in wanted.items():
        if g:
            mine = sorted(u for h, u in rows if h == g)
            assert [u for u in mine if u < cuts[g]] == mine[:k]


def test_equal_hashes_in_a_group_are_refused(spark):
    df = spark.range(5).select(F.lit(0).alias("g"), F.lit("ab" * 16).alias("u"))
    with pytest.raises(ValueError, match="not unique"):
        smallest_cuts(df, ["g"], "u", spark.range(1).select(F.lit(0).alias("g"), F.lit(2).alias("wanted")))
