import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from cohortica.functions import ordered
from cohortica.functions.ordered import (add_ranks, lookup_positions, pct_rank, pct_ranks, prefix_tree, quantiles,
                                         row_numbers, running)


@pytest.fixture(scope="module")
def data(spark):
    """One group holds most rows and one value most of that group."""
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({
        "i": np.arange(n),
        "g": np.where(rng.random(n) < 0.8, 0, rng.integers(1, 6, n)),
        "v": np.where(rng.random(n) < 0.5, 7.0, np.round(rng.normal(0, 20, n))),
        "w": rng.integers(1, 9, n),
    })
    pdf.loc[pdf.i % 97 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, df.cache()


def test_running_sum_and_max_match_pandas(data):
    pdf, df = data
    out = running(df, ["g"], ["i"], sums={"s": "w"}, maxes={"m": "w"}).toPandas().sort_values("i")
    want = pdf.sort_values("i").groupby("g").w
    assert (out.s.to_numpy() == want.cumsum().to_numpy()).all()
    assert (out.m.to_numpy() == want.cummax().to_numpy()).all()


@pytest.mark.parametrize("ranges", [1, 3, 40, 130])
@pytest.mark.parametrize("keys", [[], ["g"], ["g", "w"]])
def test_totals_reach_every_row_of_a_key(data, keys, ranges):
    pdf, df = data
    out = running(df, keys, ["i"], sums={"s": "w"}, totals={"t": "w"}, ranges=ranges).toPandas().sort_values("i")
    assert len(out) == len(pdf)
    group = pdf.groupby(keys).w if keys else pdf.assign(k=0).groupby("k").w
    assert (out.t.to_numpy() == group.transform("sum").to_numpy()).all()
    assert (out.s.to_numpy() == group.cumsum().to_numpy()).all()


def test_running_works_without_keys_and_with_many_ranges(data):
    pdf, df = data
    out = running(df, [], ["i"], sums={"s": "w"}, ranges=40).toPandas().sort_values("i")
    assert (out.s.to_numpy() == pdf.w.cumsum().to_numpy()).all()
    numbers = row_numbers(df, ["g"], ["i"]).toPandas().sort_values("i")
    assert (numbers.row_num.to_numpy() == pdf.groupby("g").cumcount().to_numpy() + 1).all()


def test_pct_rank_matches_average_ties_and_skips_nulls(data):
    pdf, df = data
    want = pdf.groupby("g").v.rank(pct=True, method="average").to_numpy()
    one = pct_rank(df, ["g"], "v", "r").toPandas().sort_values("i")
    two = add_ranks(df, ["g"], {"v": "r", "w": "rw"}).toPandas().sort_values("i")
    many = pct_ranks(df, ["i"], ["g"], ["v", "w"]).toPandas().sort_values("i")
    for got in (one.r, two.r, many.rk_v):
        np.testing.assert_allclose(got.to_numpy(float), want, atol=1e-15)
    np.testing.assert_allclose(many.rk_w, pdf.groupby("g").w.rank(pct=True), atol=1e-15)


def test_quantiles_are_linear_interpolations(data):
    pdf, df = data
    probs = [0.0, 0.025, 0.1, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r["quantile"] for r in quantiles(df, ["g"], "v", probs).collect()}
    for g, part in pdf.groupby("g"):
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.nanquantile(part.v, p), abs=1e-12)


def test_lookup_positions_reads_the_sorted_reference(data):
    pdf, df = data
    ref = df.where("v is not null")
    pos = ref.select("g", (F.lit(0) + F.col("i") % 3).alias("p")).distinct()
    got = {(r.g, r.p): r.x for r in lookup_positions(pos, ref, ["g"], "p", "v", "x").collect()}
    for (g, p), x in got.items():
        assert x == np.sort(pdf[(pdf.g == g) & pdf.v.notna()].v)[p]


def test_prefix_tree_of_three_levels_has_rows_linear_in_ranges(spark):
    """5,000 places of a hot key and 50 of a NULL one: 5,000 -> 79 -> 2 blocks."""
    rng = np.random.default_rng(3)
    rows = [("hot", i, int(rng.integers(0, 9)), int(rng.integers(-99, 99))) for i in range(5000) if i % 7]
    rows += [(None, i * 90, 1, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, seg int, s long, m long")
    out = prefix_tree(df, ["k"], "seg", {"s": F.sum, "m": F.max}, 5000)
    got = {(r.k, r.seg): (r.s, r.m) for r in out.collect()}
    assert len(got) == len(rows)
    for key in ("hot", None):
        total, most = None, None
        for _, seg, s, m in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            assert (got[key, seg][0] or 0, got[key, seg][1]) == (total or 0, most)
            total, most = (total or 0) + s, m if most is None else max(most, m)


def test_many_ranges_carry_sums_maxima_and_totals_over_null_keys(data):
    """Two levels of the tree over rows; ranges without rows, a NULL key and keys inside one range."""
    pdf, df = data
    keyed = df.withColumn("h", F.when(F.col("g") != 2, F.col("g") * 100 + F.when(F.col("g") > 3, F.col("i") % 5).otherwise(0)))
    out = running(keyed, ["h"], ["i"], sums={"s": "w"}, maxes={"m": "w"}, totals={"t": "w"}, ranges=200)
    assert out.columns == [*keyed.columns, "s", "m", "t"]
    got = out.toPandas().sort_values("i")
    group = got.assign(h=got.h.fillna(-1)).groupby("h").w
    assert (got.s.to_numpy() == group.cumsum().to_numpy()).all()
    assert (got.m.to_numpy() == group.cummax().to_numpy()).all()
    assert (got.t.to_numpy() == group.transform("sum").to_numpy()).all() and len(got) == len(pdf)


@pytest.mark.parametrize("small", [0, 1000])
def test_ranks_of_several_columns_are_not_regrouped(spark, monkeypatch, small):
    monkeypatch.setattr(ordered, "_SMALL_TABLE", small)
    rows = spark.range(400).select("id", (F.col("id") % 2).alias("m"), F.lit(1).alias("hot"),
                                   F.when(F.col("id") % 10 > 0, F.col("id") * 7 % 101).alias("x"))
    out = pct_ranks(rows, ["id"], ["m"], ["hot", "x"])
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got, pdf = out.toPandas().set_index("id").sort_index(), rows.toPandas().set_index("id")
    for c in ("hot", "x"):
        want = pdf.groupby("m")[c].rank(pct=True)
        assert np.allclose(got[f"rk_{c}"], want, equal_nan=True)
