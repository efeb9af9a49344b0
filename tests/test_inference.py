import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from cohortica.operators import inference as I
from cohortica.operators.metrics import require_both_classes
from cohortica.operators.replicates import Ordered, packed_weights
from cohortica.spec import PanelSpec
from tests.test_metrics import auc

R = 12


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(80):
        for m in (202609, 202610):
            if rng.random() < 0.8:
                y = int(rng.random() < 0.4)
                for model, noise in (("a", 1.0), ("b", 1.5), ("c", 3.0)):
                    rows.append((i, m, y, model, float(np.round(y + rng.normal() * noise, 1))))
    pdf = pd.DataFrame(rows, columns=["id_cliente", "mes", "objetivo", "model", "score"])
    return pdf, spark.createDataFrame(pdf).cache()


def test_holm_fixture(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "i int, p double")
    assert {r.i: round(r.p_holm, 12) for r in I.holm(df, "p").collect()} == {0: 0.03, 1: 0.06, 2: 0.06}
    ones = spark.createDataFrame([(0, 0.6), (1, 0.9)], "i int, p double")
    assert [r.p_holm for r in I.holm(ones, "p").collect()] == [1, 1]


def test_multinomial_draws_n_of_n(long):
    w = I.entity_weights(long[1], R, 1)
    n = long[1].select("id_cliente").distinct().count()
    assert [r["sum(weight)"] for r in w.groupBy("replicate").sum("weight").collect()] == [n] * R
    again = I.entity_weights(long[1].repartition(7), R, 1)
    assert w.exceptAll(again).count() == 0
    chunk = I.entity_weights(long[1], 4, 1, first=8)
    assert chunk.exceptAll(w).count() == 0


def test_poisson_weights_have_unit_mean(spark):
    df = spark.range(3000).withColumnRenamed("id", "id_cliente")
    w = I.entity_weights(df, 10, 1, "poisson")
    total = w.agg(F.sum("weight"), F.max("weight")).first()
    assert abs(total[0] / 30000 - 1) < 0.03 and total[1] < 12


def brute_force(pdf, weights):
    draws = {}
    for r, ws in weights.groupby("replicate"):
        w = ws.set_index("id_cliente").weight
        for (model, m), part in pdf.groupby(["model", "mes"]):
            draws[(r, model, m)] = 2 * auc(part.objetivo, part.score, part.id_cliente.map(w).fillna(0)) - 1
    return draws


def test_bootstrap_and_delta_table_match_brute_force(long):
    pdf, df = long
    table = I.bootstrap_ginis(df, R, 1, observed=True).cache()
    weights = I.entity_weights(df, R, 1).toPandas()
    want = brute_force(pdf, weights)
    got = {(r.replicate, r.model, r.mes): r.gini for r in table.collect()}
    for key, g in want.items():
        assert got[key] == pytest.approx(g, abs=1e-12)
    months = [202609, 202610]
    obs = {(mod, m): got[(I.OBSERVED, mod, m)] for mod in "abc" for m in months}
    for center in ("observed", "mean"):
        rows = {(r.a, r.b, r.period): r for r in I.delta_table(table, I.all_pairs(list("abc")), center=center).collect()}
        assert len(rows) == 9
        p = {}
        for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
            d = np.array([[want[(r, a, m)] - want[(r, b, m)] for m in months] for r in range(R)])
            mean, o = d.mean(1), np.mean([obs[(a, m)] - obs[(b, m)] for m in months])
            row = rows[(a, b, "mean")]
            mid = o if center == "observed" else mean.mean()
            p[(a, b)] = (1 + np.sum(np.abs(mean - mid) >= abs(o) - 1e-12)) / (R + 1)
            assert row.delta == pytest.approx(o) and row.p_two_sided == pytest.approx(p[(a, b)])
            assert (row.ci_low, row.ci_high) == pytest.approx(tuple(np.quantile(mean, [0.025, 0.975])))
            one = rows[(a, b, "202609")]
            assert one.ci_low == pytest.approx(np.quantile(d[:, 0], 0.025)) and one.p_holm is None
        run = 0.0
        for k, pair in enumerate(sorted(p, key=lambda x: (p[x], x))):
            run = max(run, min(1.0, (3 - k) * p[pair]))
            assert rows[(*pair, "mean")].p_holm == pytest.approx(run)


def test_chunks_equal_one_run(long):
    a = I.bootstrap_in_chunks(long[1], R, 1, chunk=5)
    b = I.bootstrap_ginis(long[1], R, 1, observed=True)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_probability_of_best_splits_ties(spark):
    table = spark.createDataFrame([(0, "a", 1, 0.5), (0, "b", 1, 0.5), (1, "a", 1, 0.6), (1, "b", 1, 0.1), (-1, "a", 1, 0.0)],
                                  "replicate int, model string, mes int, gini double")
    assert {r.model: r.p_best for r in I.probability_of_best(table).collect()} == {"a": 0.75, "b": 0.25}


def test_single_class_replicates_are_skipped_or_an_error(spark):
    df = spark.createDataFrame([(1, 0, 0.2, 0.3), (2, 1, 0.4, 0.1)], "id_cliente long, objetivo int, a double, b double")
    row = I.pooled_delta(df, "a", "b", 40, 1).first()
    assert 0 < row.bootstrap_replicates < 40 and row.delta_gini == 2
    long = df.unpivot(["id_cliente", "objetivo"], ["a", "b"], "model", "score")
    with pytest.raises(Exception, match="single class"):
        require_both_classes(I.bootstrap_ginis(long, 40, 1, ["model"])).collect()


def test_best_row_ties_follow_priority(spark):
    df = spark.createDataFrame([("z", 0, 0.3), ("y", 1, 0.3 + 1e-14), ("x", 2, 0.1)], "name string, prio int, g double")
    assert I.best_row(df, "g", ["prio"]).first()["name"] == "z"


def test_gate_and_winner(spark):
    ci = lambda low: spark.createDataFrame([(0.01, low)], "delta_gini double, ci95_low double")
    cohorts = spark.createDataFrame([("new", 0.0), ("recurrent", None)], "c string, delta double")
    assert I.gate(ci(0.1), ci(0.1), cohorts).first().passed
    assert not I.gate(ci(0.1), ci(-0.1), cohorts).first().passed
    assert not I.gate(ci(0.1), ci(0.1), cohorts.withColumn("delta", F.lit(-0.1))).first().passed
    slices = spark.createDataFrame([("period", 0.1), ("cohort", 0.0)], "slice string, gini double")
    assert I.winner_status(ci(0.1), slices).first().status == "conclusive_winner"
    assert I.winner_status(ci(0.0), slices).first().status == "no_conclusive_winner"


def test_promotion_labels(spark):
    df = spark.createDataFrame([(0.26, 0.2, 0.9), (0.252, 0.2, 0.9), (0.2, 0.26, 0.9), (0.249, 0.2, 0.9), (0.249, 0.2, 0.99)],
                               "g double, b double, s double")
    got = [r[0] for r in df.select(I.promotion_label(F.col("g"), F.col("b"), F.col("s"), 0.25)).collect()]
    assert got == ["promote", "competitive", "ensemble-only (blend)", "ensemble-only", "reject"]


def test_one_entity_is_no_bootstrap(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.1, 0.2), (1, 2, 1, 0.5, 0.4)], "id_cliente long, mes int, objetivo int, a double, b double")
    with pytest.raises(ValueError, match="two entities"):
        I.pooled_delta(df, "a", "b", 5, 1)


def test_packed_ordered_pairs_merge_over_any_cut(long):
    """States of consecutive pieces, ties across the cuts, merge to the state of the whole."""
    rng = np.random.default_rng(5)
    score = np.sort(rng.integers(0, 6, 60)).astype(float)
    label, weights = rng.integers(0, 2, 60).astype(float), rng.integers(0, 4, (60, 7)).astype(float)
    pos, neg = weights * label[:, None], weights * (1 - label)[:, None]
    whole = Ordered.of(score, pos, neg)
    for _ in range(30):
        cuts = [0, *sorted(rng.choice(np.arange(1, 60), rng.integers(1, 20), replace=False)), 60]
        parts = [Ordered.of(score[a:z], pos[a:z], neg[a:z]) for a, z in zip(cuts, cuts[1:])]
        while len(parts) > 1:                                            # merge neighbours anywhere
            i = rng.integers(0, len(parts) - 1)
            parts[i:i + 2] = [Ordered.unpack(pa.py_buffer(parts[i].then(parts[i + 1]).pack()))]
        assert parts[0].pack() == whole.pack()
    for r in range(7):
        assert whole.pairs[r] / (whole.pos[r] * whole.neg[r]) == pytest.approx(auc(label, score, weights[:, r]))


def test_packed_bootstrap_over_a_hot_tie_many_ranges_and_null_keys(spark):
    """One score holds most rows and spans ranges; 130 ranges merge through two levels."""
    rng = np.random.default_rng(9)
    rows = [(f"c{i % 70}", None if i % 3 else "k", int(rng.random() < 0.4), 0.5 if rng.random() < 0.7 else float(rng.integers(0, 9)) / 8)
            for i in range(1500)]
    df = spark.createDataFrame(rows, "client string, grp string, y int, score double")
    spec = PanelSpec(entity="client", label="y")
    weights = I.entity_weights(df, 5, 3, first=2, spec=spec).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "130")
    try:
        got = {(r.replicate, r.grp): r.gini for r in I.bootstrap_ginis(df, 5, 3, ["grp"], first=2, observed=True, spec=spec).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    pdf = df.toPandas()
    assert len(got) == 12
    for (replicate, grp), gini in got.items():
        part = pdf[pdf.grp.isna() if grp is None else pdf.grp == grp]
        w = 1 if replicate == I.OBSERVED else part.client.map(
            weights[weights.replicate == replicate].set_index("client").weight).fillna(0)
        assert gini == pytest.approx(2 * auc(part.y, part.score, pd.Series(w, index=part.index)) - 1, abs=1e-12)


def test_best_row_keeps_one_row_a_group(spark):
    df = spark.createDataFrame([("x", "b", 0.5), ("x", "a", 0.5 + 1e-14), ("y", "c", None), ("y", "d", 0.1), ("z", "e", None)],
                               "g string, name string, m double")
    assert {(r.g, r.name) for r in I.best_row(df, "m", ["name"], ["g"]).collect()} == {("x", "a"), ("y", "d"), ("z", "e")}
    assert I.best_row(df, "m", ["name"]).first().name == "a" and I.best_row(df.where("g = 'q'"), "m", ["name"]).count() == 0


def test_a_task_holds_few_draws(spark, monkeypatch):
    entities = spark.range(2500).withColumnRenamed("id", "id_cliente")
    kind, caught = type(entities), []
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, schema: caught.append(f) or real(df, f, schema))
    packed_weights(entities, 1000, 1)
    tracemalloc.start()
    try:
        packs = list(caught[0](iter([pa.RecordBatch.from_pydict({"_pos": list(range(2500))})])))
        assert tracemalloc.get_traced_memory()[1] < 64e6
    finally:
        tracemalloc.stop()
    assert sum(len(p) for batch in packs for p in batch.column(1).to_pylist()) == 4 * 2500 * 1000
