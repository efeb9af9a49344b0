import pytest

from pyspark.sql import functions as F

from cohortica.operators import contracts as C
from cohortica.operators import joins as J

DDL = "id_cliente long, mes int, x double, objetivo int"


def good(spark):
    train = spark.createDataFrame([(1, 202601, 1.0, 0), (1, 202602, 2.0, 1), (2, 202602, 3.0, 0)], DDL)
    score = spark.createDataFrame([(2, 202603, 1.0), (9, 202603, 2.0)], "id_cliente long, mes int, x double")
    return train, score


def test_valid_panel_gives_a_report(spark):
    assert C.validate_panel(*good(spark)) == {"n_rows": 2, "seen_rows": 1, "unseen_rows": 1}


@pytest.mark.parametrize("break_it", [
    lambda t, s: (t.unionByName(t.limit(1)), s),
    lambda t, s: (t.unionByName(t.sparkSession.createDataFrame([(1, 202603, 1.0, 0)], DDL)), s.withColumn("mes", F.lit(202604))),
    lambda t, s: (t, s.withColumn("y", F.lit(1))),
    lambda t, s: (t, s.select("mes", "id_cliente", "x")),
    lambda t, s: (t, s.withColumn("objetivo", F.lit(0))),
    lambda t, s: (t.withColumn("x", F.lit(None).cast("double")), s),
    lambda t, s: (t.withColumn("x", F.lit(float("nan"))), s),
    lambda t, s: (t.withColumn("objetivo", F.lit(0)), s),
    lambda t, s: (t.withColumn("objetivo", F.lit(2)), s),
    lambda t, s: (t, s.withColumn("mes", F.lit(202602))),
    lambda t, s: (t, s.withColumn("mes", F.lit(202613))),
    lambda t, s: (t.withColumn("objetivo", F.when(F.col("id_cliente") == 1, 1).otherwise(0)), s),
])
def test_broken_panels_raise(spark, break_it):
    with pytest.raises(C.ContractViolation):
        C.validate_panel(*break_it(*good(spark)))


def submission(spark, rows):
    return spark.createDataFrame(rows, "row_ord long, id_cliente long, prediccion string")


def test_submission_check(spark):
    ref = spark.createDataFrame([(0, 5), (1, 7)], "row_ord long, id_cliente long")
    assert not any(C.submission_check(submission(spark, [(0, 5, "0"), (1, 7, "1.0")]), ref).first())


@pytest.mark.parametrize("rows,problem", [
    ([(0, 5, "-0.01"), (1, 7, "1")], "out_of_range"), ([(0, 5, "1.01"), (1, 7, "1")], "out_of_range"),
    ([(0, 5, "NaN"), (1, 7, "1")], "non_finite"), ([(0, 5, "x"), (1, 7, "1")], "non_numeric"),
    ([(0, 7, "0.5"), (1, 5, "0.5")], "id_mismatches"), ([(0, 5, "0.5")], "missing_rows"),
    ([(0, 5, "0.5"), (1, 7, "0.5"), (2, 8, "0.5")], "extra_rows")])
def test_bad_submissions(spark, rows, problem):
    ref = spark.createDataFrame([(0, 5), (1, 7)], "row_ord long, id_cliente long")
    counts = C.submission_check(submission(spark, rows), ref)
    assert counts.first()[problem] > 0
    with pytest.raises(C.ContractViolation):
        C.enforce(counts)


def test_infinite_scores_are_counted(spark):
    ref = spark.createDataFrame([(0, 5)], "row_ord long, id_cliente long")
    assert C.submission_check(submission(spark, [(0, 5, "Infinity")]), ref).first().non_finite == 1


def test_row_set_difference_counts_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    b = spark.createDataFrame([(1,), (3,)], "k long")
    assert tuple(C.row_set_difference(a, b, ["k"]).first()) == (2, 1)


def tables(spark):
    a = spark.createDataFrame([(1, 202609, 0, 0.1), (2, 202609, 1, 0.2)], "id_cliente long, mes int, objetivo int, m1 double")
    b = spark.createDataFrame([(2, 202609, 1, 0.8), (1, 202609, 0, 0.7)], "id_cliente long, mes int, objetivo int, m2 double")
    return a, b


def test_strict_join_matches_by_key(spark, rows):
    assert rows(J.strict_join(tables(spark)), "id_cliente", "objetivo", "m1", "m2") == [(1, 0, 0.1, 0.7), (2, 1, 0.2, 0.8)]


@pytest.mark.parametrize("break_it", [
    lambda b: b.unionByName(b.limit(1)),
    lambda b: b.where("id_cliente = 1"),
    lambda b: b.withColumn("id_cliente", F.col("id_cliente") + 1),
    lambda b: b.withColumn("objetivo", 1 - F.col("objetivo")),
    lambda b: b.withColumnRenamed("m2", "m1")])
def test_strict_join_rejects(spark, break_it):
    a, b = tables(spark)
    with pytest.raises(C.ContractViolation):
        J.strict_join([a, break_it(b)])


def test_align_to_uses_ids(spark, rows):
    ref = spark.createDataFrame([(0, 7), (1, 5)], "row_ord long, id long")
    values = spark.createDataFrame([(5, 0.5), (7, 0.7)], "id long, v double")
    assert rows(J.align_to(values, ref, "id"), "row_ord", "id", "v") == [(0, 7, 0.7), (1, 5, 0.5)]
    with pytest.raises(C.ContractViolation, match="missing ids: 1"):
        J.align_to(values.where("id = 5"), ref, "id")
    with pytest.raises(C.ContractViolation, match="unexpected ids: 1"):
        J.align_to(values.unionByName(values.select(F.lit(9).cast("long").alias("id"), "v").limit(1)), ref, "id")
    with pytest.raises(C.ContractViolation, match="duplicate"):
        J.align_to(values.unionByName(values), ref, "id")


def test_risk_set_join_handles_long_intervals(spark, rows):
    iv = spark.createDataFrame([(1, 0, 3), (2, 1, 2), (3, 2, 4)], "id long, start int, stop int")
    times = spark.createDataFrame([(2,), (4,)], "event_time int")
    got = rows(J.risk_set(iv, times), "event_time", "id")
    assert got == [(2, 1), (2, 2), (4, 3)]


def test_fractions_are_not_labels(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.7,)], "y double")
    assert C.binary_label(df, "y").first().invalid_labels == 1


def test_repeated_predictions_are_counted(spark):
    want = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    got = spark.createDataFrame([(1, 0.5), (1, 0.6), (2, 7.0), (9, 0.1)], "k long, p double")
    assert C.probability_coverage(want, got, ["k"], "p").first().asDict() == {
        "missing_predictions": 1, "unexpected_predictions": 1, "duplicate_predictions": 1, "invalid_probabilities": 1}
    audit = C.prediction_audit(want, got.withColumn("run", F.lit("r")), "run", ["k"], "p").first()
    assert (audit.n_rows, audit.missing_rows, audit.unexpected_rows, audit.duplicate_rows, audit.invalid) == (4, 1, 1, 1, 1)


def test_join_report_counts_copies_and_null_labels(spark):
    a = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, None)], "id_cliente long, mes int, objetivo int")
    b = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 1)], "id_cliente long, mes int, objetivo int")
    row = J.strict_join_report(a, b).first()
    assert (row.n_rows, row.duplicates_left, row.duplicates_right, row.label_differences) == (2, 1, 1, 1)


def test_layout_problems_as_rows(spark):
    train = spark.createDataFrame([], "id_cliente long, mes int, objetivo int, x int")
    assert C.layout_problems(train, train.drop("objetivo")).count() == 0
    assert C.layout_problems(train, train.drop("mes")).count() == 3
