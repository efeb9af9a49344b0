import hashlib

import pytest

from pyspark.sql import functions as F

from cohortica.operators import profile as P
from cohortica.operators import splits as S

MONTHS = list(range(202601, 202610))


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame([(i, m, (i + m) % 7) for i in range(120) for m in MONTHS if (i + m) % 4],
                                 "id_cliente long, mes int, x int").cache()


def test_inner_folds_walk_forward(panel):
    assert S.inner_cuts(MONTHS) == [(202605, 202606), (202606, 202607), (202607, 202608), (202608, 202609)]
    assert S.inner_cuts(MONTHS, end=202608)[-1] == (202607, 202608)
    with pytest.raises(ValueError):
        S.inner_cuts(MONTHS[:4])
    with pytest.raises(ValueError):
        S.outer_cuts(MONTHS[:2])
    folds = S.inner_folds(panel).groupBy("fold", "role").agg(F.max("mes").alias("hi"), F.min("mes").alias("lo"))
    for r in folds.collect():
        assert (r.hi < r.fold) if r.role == "train" else (r.lo == r.hi == r.fold)


def test_outer_holdout_takes_the_last_two(panel):
    roles = {(r.mes, r.role) for r in S.outer_holdout(panel).select("mes", "role").distinct().collect()}
    assert roles == {(m, "valid" if m >= 202608 else "train") for m in MONTHS}


def test_sliding_window(panel):
    out = S.assign_folds(panel, [(202606, 202607)], window=3).where("role = 'train'")
    assert {r.mes for r in out.select("mes").distinct().collect()} == {202604, 202605, 202606}


def test_entity_holdout_is_disjoint_and_matches_sha256(panel):
    out = S.entity_holdout(panel, 202607)
    train, valid = ({r[0] for r in out.where(F.col("role") == role).select("id_cliente").distinct().collect()}
                    for role in ("train", "valid"))
    assert train and valid and not train & valid
    want = {i for i in range(120) if int(hashlib.sha256(str(i).encode()).hexdigest()[:8], 16) % 5 == 0}
    assert valid <= want and not train & want


@pytest.mark.parametrize("method", ["uniform", "balanced-by-month", "recency-aware"])
@pytest.mark.parametrize("n", [9, 50, 333])
def test_samples_are_exact_and_repeatable(panel, method, n):
    a = S.stratified_sample(panel, n, method, 1)
    assert a.count() == n and a.distinct().count() == n
    assert a.exceptAll(S.stratified_sample(panel.repartition(5), n, method, 1)).count() == 0
    if method != "uniform":
        assert a.select("mes").distinct().count() == len(MONTHS)


def test_sample_larger_than_the_table_is_the_table(panel):
    assert S.stratified_sample(panel, 10 ** 6, "balanced-by-month", 1).count() == panel.count()


def test_sample_fills_the_shortfall_of_small_months(spark):
    df = spark.createDataFrame([(i, 202601) for i in range(2)] + [(i, 202602) for i in range(50)], "id_cliente long, mes int")
    out = S.stratified_sample(df, 20, "balanced-by-month", 3)
    assert {r.mes: r["count"] for r in out.groupBy("mes").count().collect()} == {202601: 2, 202602: 18}


def test_recency_weights_favour_late_months(spark):
    counts = spark.createDataFrame([(m, 1000) for m in MONTHS], "mes int, n_rows long")
    q = {r.mes: r.quota for r in S.period_quotas(counts, 270, "recency-aware").collect()}
    assert sum(q.values()) == 270 and q[202609] > q[202601] and q[202609] == 40 and q[202601] == 20


def test_permutation_keeps_the_values_of_each_month(panel):
    out = S.permute_within_period(panel, "x", 5)
    assert out.count() == panel.count()
    a, b = (d.groupBy("mes", "x").count() for d in (panel, out))
    assert a.exceptAll(b).count() == 0
    moved = out.join(panel.withColumnRenamed("x", "x0"), ["id_cliente", "mes"]).where("x <> x0").count()
    assert moved > panel.count() / 2


def test_noise_and_label_draws(panel):
    noise = S.inject_noise(panel, "x", 1, 364, 5, 2)
    row = noise.agg(F.min("x"), F.max("x"), F.avg("x"), F.count("*")).first()
    assert row[0] >= 1 and row[1] <= 364 and abs(row[2] - 182.5) < 10 and row[3] == 5 * panel.count()
    drawn = S.redraw_labels(panel.withColumn("p", F.lit(0.3)), "p", 20, 1)
    assert abs(drawn.agg(F.avg("objetivo")).first()[0] - 0.3) < 0.02


def test_entity_overlap(panel):
    out = P.entity_overlap(S.assign_folds(panel, [(202606, 202607)]), "id_cliente").first()
    a = {r[0] for r in panel.where("mes <= 202606").select("id_cliente").collect()}
    b = {r[0] for r in panel.where("mes = 202607").select("id_cliente").collect()}
    assert (out.train_entities, out.valid_entities, out.overlap) == (len(a), len(b), len(a & b))


def test_short_or_empty_splits_are_refused(spark):
    two = spark.createDataFrame([(1, 202601, 0), (2, 202602, 0)], "id_cliente long, mes int, objetivo int")
    with pytest.raises(ValueError, match="three periods"):
        S.outer_holdout(two)
    with pytest.raises(ValueError, match="no "):
        S.entity_holdout(two.where("mes = 202601"), 202601)


@pytest.mark.parametrize("method", ["balanced-by-month", "recency-aware"])
@pytest.mark.parametrize("sizes,n", [([100] * 5, 17), ([100] * 7, 7), ([100] * 9, 10), ([3, 100, 100], 60), ([50] * 12, 200)])
def test_quotas_follow_their_definition(spark, method, sizes, n):
    counts = spark.createDataFrame([(202601 + i, s) for i, s in enumerate(sizes)], "mes int, n_rows long")
    got = {r.mes: r.quota for r in S.period_quotas(counts, n, method).collect()}
    k = len(sizes)
    weight = [1.0 if method == "balanced-by-month" else 1 + i / (k - 1) for i in range(k)]
    share = [w / sum(weight) * n for w in weight]
    assert all(1 <= got[202601 + i] <= max(1, int(share[i]) + 1) for i in range(k))
    if min(sizes) > max(share) + 1:
        assert sum(got.values()) == n
