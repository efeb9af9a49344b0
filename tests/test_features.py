import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from cohortica.functions import features as X
from cohortica.functions.periods import in_recent_window, month_index, ordinal, time_decay
from cohortica.operators import calendar as CAL
from cohortica.operators import encoding as E
from cohortica.operators import families as FAM
from cohortica.operators import history as H
from cohortica.operators.contracts import check_causal
from cohortica.spec import DEFAULT, PanelSpec


def frame(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


@pytest.fixture()
def visits(spark):
    return frame(spark, [(1, 202601, 10), (2, 202601, 50), (1, 202603, 30), (1, 202604, 5), (2, 202602, 40)],
                 "id_cliente long, mes int, x int")


def test_history_counts_prior_rows(spark, rows):
    df = frame(spark, [(1, 202601), (2, 202601), (1, 202602), (3, 202602), (2, 202603), (4, 202603)],
               "id_cliente long, mes int")
    got = rows(H.add_history(df), "id_cliente", "mes", "n_observaciones_previas", "cliente_recurrente",
               "meses_desde_entrada", "meses_en_riesgo", "mes_primera_aparicion")
    assert (1, 202601, 0, False, 0, 1, 202601) in got
    assert (1, 202602, 1, True, 1, 2, 202601) in got
    assert (2, 202603, 1, True, 2, 3, 202601) in got


def test_trajectory_fixture(visits):
    out = {(r.id_cliente, r.mes): r for r in H.trajectory(visits, "x").collect()}
    march, april = out[(1, 202603)], out[(1, 202604)]
    assert march.interaction_slope == pytest.approx(10)
    assert (april.interaction_reset, april.interaction_resets, april.interaction_lag2) == (1, 1, 10)
    assert out[(1, 202601)].interaction_lag1 is None
    assert out[(1, 202601)].interaction_slope is None


def test_trajectory_is_causal(visits):
    report = check_causal(lambda d: H.trajectory(d, "x"), visits, [202601, 202602, 202603])
    assert [r.changed_rows for r in report.collect()] == [0, 0, 0]


def test_check_causal_sees_a_leak(visits):
    leak = lambda d: d.join(d.agg(F.max("x").alias("top")), how="cross")
    assert sum(r.changed_rows for r in check_causal(
        leak, visits.where("id_cliente = 1"), [202601]).collect()) > 0


def test_target_encoding_fixture(spark):
    data = list(zip(range(7), [202601] * 3 + [202602] * 2 + [202603] * 2, "aababab", [1, 0, 0, 1, 0, 0, 1]))
    df = frame(spark, data, "id_cliente long, mes int, g string, objetivo int")
    te = {r.id_cliente: r.te_g for r in E.causal_target_encoding(df, {"g": F.col("g")}, 2.0).collect()}
    assert [te[i] for i in range(3)] == [None] * 3
    assert te[3] == pytest.approx((1 + 2 / 3) / 4)
    assert te[4] == pytest.approx((2 / 3) / 3)
    assert te[5] == pytest.approx((2 + 4 / 5) / 5)


def test_target_encoding_ignores_same_period_and_unlabelled_rows(spark):
    data = [(1, 202601, "a", 1), (2, 202601, "b", 0), (3, 202602, "a", None), (4, 202602, "a", None)]
    df = frame(spark, data, "id_cliente long, mes int, g string, objetivo int")
    te = {r.id_cliente: r.te_g for r in E.causal_target_encoding(df, {"g": F.col("g")}, 2.0).collect()}
    assert te[3] == te[4] == pytest.approx((1 + 2 * 0.5) / 3)


def test_within_month_ranks_fixture(spark, rows):
    from cohortica.functions.ordered import pct_ranks
    df = frame(spark, [(1, 1, 3, 1), (2, 1, 1, 1), (3, 1, 2, 1), (4, 2, 10, 5), (5, 2, 20, 5)],
               "id_cliente long, mes int, v int, w int")
    got = {r.id_cliente: (r.rk_v, r.rk_w) for r in pct_ranks(df, ["id_cliente"], ["mes"], ["v", "w"]).collect()}
    assert got[1] == pytest.approx((1, 2 / 3)) and got[2] == pytest.approx((1 / 3, 2 / 3))
    assert got[4] == pytest.approx((0.5, 0.75)) and got[5] == pytest.approx((1, 0.75))


def test_ratio_guards(spark):
    ddl = ("id_cliente long, mes int, edad int, ingresos double, ratio_deuda_ingresos double, antiguedad_cuenta_meses int, "
           "numero_productos int, saldo_promedio double, dias_ultima_transaccion int, visitas_web_ultimos_90_dias int, "
           "dias_ultima_interaccion int")
    df = frame(spark, [(1, 202601, 30, 1000.0, 0.25, 23, 2, 500.0, 24, 8, 30),
                       (2, 202601, 18, 1000.0, 0.5, 0, 0, 0.0, 5, 3, 6)], ddl)
    out = {r.id_cliente: r for r in FAM.families()["F2_ratios"][0](df).collect()}
    a, b = out[1], out[2]
    assert a.saldo_ingresos == 0.5 and a.ingreso_neto == 750
    assert a.antiguedad_share_vida_adulta == pytest.approx(23 / 144)
    assert a.productos_por_anio_antiguedad == 1 and a.visitas_por_producto == 4 and a.recencia_ratio == 1
    assert b.antiguedad_share_vida_adulta == 0 and b.visitas_por_producto == 3
    assert (a.gap_interaccion_rank, b.gap_interaccion_rank) == (1, 0.5)


def test_cohort_survival_and_ranks(spark):
    df = frame(spark, [(1, 202601, 1.0), (2, 202601, 2.0), (3, 202601, 3.0), (1, 202602, 5.0), (2, 202602, 4.0),
                       (4, 202602, 9.0), (1, 202603, 1.0)], "id_cliente long, mes int, v double")
    surv = {(r.id_cliente, r.mes): r.cohort_survival for r in H.cohort_survival(df).collect()}
    rank = {(r.id_cliente, r.mes): r.cohort_rk_v for r in H.cohort_ranks(df, ["v"]).collect()}
    assert surv[(3, 202601)] == 1 and surv[(1, 202602)] == pytest.approx(2 / 3)
    assert surv[(1, 202603)] == pytest.approx(1 / 3) and surv[(4, 202602)] == 1
    assert rank[(1, 202601)] == pytest.approx(1 / 3) and rank[(3, 202601)] == 1
    assert rank[(1, 202602)] == 1 and rank[(4, 202602)] == 1


def test_calendar_fixtures(spark):
    df = frame(spark, [(1, 202612, 8), (2, 202601, 3), (3, 202601, 4), (4, 202606, 7)],
               "id_cliente long, mes int, dia_preferido_pago int")
    out = {r.id_cliente: r for r in CAL.add_calendar(df, "mes", "dia_preferido_pago", flags=True).collect()}
    d = out[1]
    assert (d.pay_weekday, d.pay_is_weekend, d.pay_is_holiday, d.pay_days_to_business_day) == (1, 0, 1, 2)
    assert (d.month_business_days, d.month_holidays, d.month_days) == (20, 3, 31)
    assert (d.gratificacion_month, d.cts_month) == (1, 0)
    assert [out[i].pay_days_to_business_day for i in (2, 3, 4)] == [2, 1, 1]
    assert [out[i].pay_is_holiday for i in (2, 3, 4)] == [0, 0, 1]
    assert len(CAL.HOLIDAYS_2026) == 16


def test_calendar_rejects_other_years(spark):
    df = frame(spark, [(1, 202512, 8)], "id_cliente long, mes int, dia_preferido_pago int")
    with pytest.raises(Exception, match="outside the holiday table"):
        CAL.add_calendar(df, "mes", "dia_preferido_pago").collect()


def test_period_expressions(spark):
    df = frame(spark, [(m,) for m in (202603, 202606, 202609)], "mes int")
    out = df.select(time_decay("mes", F.lit(202609), 3).alias("w"), ordinal("mes").alias("o"),
                    month_index("mes", 202601).alias("i")).collect()
    assert [r.w for r in out] == [0.25, 0.5, 1.0]
    assert [r.i for r in out] == [2, 5, 8] and out[0].o == 2026 * 12 + 2
    far = frame(spark, [(202512,), (202601,), (202602,)], "mes int").select(
        time_decay("mes", F.lit(202602), 1).alias("w")).collect()
    assert [r.w for r in far] == [0.25, 0.5, 1.0]
    win = frame(spark, [(m,) for m in (202602, 202603, 202608, 202609)], "mes int").select(
        in_recent_window("mes", 202608, 6).alias("x")).collect()
    assert [r.x for r in win] == [False, True, True, False]
    with pytest.raises(ValueError):
        time_decay("mes", F.lit(1), 0)


def test_category_codes_put_unseen_values_last(spark):
    train = frame(spark, [(1, "b"), (2, "a"), (3, None)], "id long, c string")
    vocab = E.category_vocabulary(train, ["c"])
    assert {r.value: r.code for r in vocab.collect()} == {"__UNKNOWN__": 0, "a": 1, "b": 2}
    new = frame(spark, [(1, "a"), (2, "zz"), (3, None)], "id long, c string")
    codes = {r.id: r.c_code for r in E.encode_categories(new, vocab, ["c"], ["id"]).collect()}
    assert codes == {1: 1, 2: 3, 3: 0}


def test_quantile_bins_follow_training_edges(spark):
    rng = np.random.default_rng(0)
    train = pd.DataFrame({"id": range(200), "v": rng.normal(size=200)})
    fresh = pd.DataFrame({"id": range(50), "v": rng.normal(size=50) * 3})
    got = E.quantile_bins(spark.createDataFrame(train), spark.createDataFrame(fresh), ["v"], 5, ["id"]).toPandas()
    edges = np.quantile(train.v, np.linspace(0, 1, 6))[1:-1]
    want = np.searchsorted(edges, fresh.v, side="right")
    assert (got.sort_values("id").v_bin.to_numpy() == want).all()


def test_right_closed_bins(spark):
    df = frame(spark, [(v,) for v in (0, 1, 100, 101, 180, 400, 401)], "v int")
    got = [r[0] for r in df.select(X.right_closed_bin(F.col("v"), [0, 100, 180, 400])).collect()]
    assert got == [None, 1, 1, 2, 2, 3, None]


def test_families_and_clash(spark):
    df = frame(spark, [(1, 202601, 0, 1.0), (2, 202601, 1, 2.0)], "id_cliente long, mes int, objetivo int, a double")
    registry = {"twice": (lambda d: d.select("id_cliente", "mes", (F.col("a") * 2).alias("a2")), []),
                "clash": (lambda d: d.select("id_cliente", "mes", "a"), []),
                "swap": (lambda d: d.select("id_cliente", "mes", (F.col("a") + 1).alias("b")), ["a"])}
    out = FAM.apply_family(df, df, "twice", registry=registry)
    assert sorted(r.a2 for r in out.collect()) == [2.0, 4.0]
    assert "a" not in FAM.apply_family(df, df, "swap", registry=registry).columns
    with pytest.raises(ValueError, match="repeats"):
        FAM.apply_family(df, df, "clash", registry=registry)


def test_variants_never_contain_the_label(spark):
    df = frame(spark, [(1, 202601, 0, 1.0)], "id_cliente long, mes int, objetivo int, a double")
    assert FAM.variant(df, "clean")[1] == ["mes", "a"]
    assert FAM.variant(df, "id_raw")[1] == ["id_cliente", "mes", "a"]
    assert "n_observaciones_previas" in FAM.variant(df, "history")[1]
    for name in "ABCD":
        assert not {"objetivo", "id_cliente"} & set(FAM.matrix(df, name)[1])
    with pytest.raises(ValueError):
        FAM.variant(df, "other")


def test_other_column_names(spark):
    spec = PanelSpec(entity="who", period="when", label="y")
    df = frame(spark, [(1, 202601, 0), (1, 202603, 1)], "who long, when int, y int")
    out = H.risk_intervals(df, spec).orderBy("when").collect()
    assert [(r.start, r.stop) for r in out] == [(0, 1), (2, 3)]
    assert DEFAULT.entity == "id_cliente"


def test_history_never_reads_the_label(spark):
    a = frame(spark, [(1, 202601, 0), (1, 202602, 0), (2, 202602, 1)], "id_cliente long, mes int, objetivo int")
    b = a.withColumn("objetivo", 1 - F.col("objetivo"))
    left, right = (H.add_history(d).drop("objetivo") for d in (a, b))
    assert left.exceptAll(right).count() == 0


def test_rule_flags(spark):
    ddl = ("banda_riesgo string, numero_productos int, dias_ultima_transaccion int, activo_movil boolean, "
           "tiene_tarjeta_credito boolean, canal_adquisicion string, ratio_deuda_ingresos double, saldo_promedio double, k int")
    df = frame(spark, [("low", 3, 73, True, True, "web", 0.6, 300.0, 1), ("high", 1, 180, False, True, "branch", 0.9, 301.0, 2)], ddl)
    a, b = df.select(*[e.alias(n) for n, e in X.rule_flags("k").items()]).collect()
    assert (a.L, a.L_p3, a.L_mc_p2, a.L_dtx, a.LM_debt60, a.saldo_floor, a.k) == (1, 1, 1, 0.2, 1, 1, 0)
    assert (b.H, b.H_dtx100, b.H_dtx180, b.H_old_branch, b.M_dtx, b.LM_debt60) == (1, 0, 0, 1, 0, 0)
