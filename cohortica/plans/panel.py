"""The person-period panel that the registered queries run on.

One row per customer and order month, up to the customer's first fulfilled
urgent order (the event). Column names follow the published panel schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortica.functions.periods import ordinal
from cohortica.sources.readers import read_table

# Validation months of the rolling cuts: (train_through, valid_month).
CUTS = [(199812, 199901), (199901, 199902), (199902, 199903)]
VALID_MONTHS = [valid for _, valid in CUTS]
# Last labelled month; the following month plays the unlabelled score table.
TRAIN_THROUGH = 200012
SCORE_MONTH = 200101
RISK_BANDS = ["low", "medium", "high"]
CHANNELS = ["branch", "web", "app", "referral"]
DEVICES = ["android", "ios", "desktop", "other"]


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def order_months(spark: SparkSession, sf_dir: str, through: int | None = None) -> DataFrame:
    """Orders collapsed to customer-months, cut after the first event.

    ``through`` is the last month wanted. Nothing in the panel looks ahead, so the bound
    goes to the scan and leaves the kept months as they are.

    The month count bounds a customer's rows, so windows over one customer stay
    small however many orders that customer has.
    """
    orders = read_table(spark, sf_dir, "orders")
    if through is not None:
        year, month = divmod(through, 100)
        after = f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"
        orders = orders.where(F.col("o_orderdate") < F.lit(after).cast("timestamp_ntz"))
    urgent = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    months = orders.groupBy(
        F.col("o_custkey").alias("id_cliente"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("mes"),
    ).agg(
        F.max(urgent.cast("int")).alias("objetivo"),
        F.count(F.lit(1)).cast("int").alias("numero_productos"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("gasto"),
        F.min(F.to_date("o_orderdate")).alias("_first_day"),
        F.max(F.to_date("o_orderdate")).alias("_last_day"),
    )
    entity = Window.partitionBy("id_cliente")
    event = F.min(F.when(F.col("objetivo") == 1, F.col("mes"))).over(entity)
    return months.withColumn("_event", event).where(
        F.col("_event").isNull() | (F.col("mes") <= F.col("_event"))).drop("_event")


def panel(spark: SparkSession, sf_dir: str, through: int | None = None) -> DataFrame:
    """Customer-months up to ``through`` in the published schema plus ``gasto`` (spend)."""
    history = Window.partitionBy("id_cliente").orderBy("mes")
    months = order_months(spark, sf_dir, through).select(
        "*",
        F.datediff("_last_day", F.lag("_last_day").over(history)).alias("_gap"),
        (F.row_number().over(history) == 1).alias("es_nuevo_cliente"),
        (ordinal("mes") - ordinal(F.min("mes").over(history))).alias("antiguedad_cuenta_meses"),
    )
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    customer = (read_table(spark, sf_dir, "customer")
                .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
                .select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey", "r_name"))
    # The windows left the months partitioned and sorted by customer; a merge join
    # keeps that and only moves the customer side.
    rows = months.join(customer.hint("merge"), F.col("id_cliente") == F.col("c_custkey"))
    cid, nat = F.col("id_cliente"), F.col("c_nationkey")
    dtx = F.coalesce(F.least(F.col("_gap"), F.lit(364)), F.lit(364))
    noise = F.lit(1) + F.pmod(cid * 31 + ordinal("mes") * 17, F.lit(364))
    return rows.select(
        "id_cliente", "mes", "objetivo",
        (F.lit(20) + F.pmod(cid * 7, F.lit(50))).cast("int").alias("edad"),
        F.round(F.lit(12000) + F.abs("c_acctbal") * 5, 2).alias("ingresos"),
        (F.pmod(cid * 13, F.lit(100)) / F.lit(100.0)).alias("ratio_deuda_ingresos"),
        "antiguedad_cuenta_meses", "numero_productos",
        F.col("c_acctbal").alias("saldo_promedio"),
        dtx.alias("dias_ultima_transaccion"),
        F.col("c_mktsegment").alias("ocupacion"),
        F.col("r_name").alias("region"),
        _pick(F.pmod(nat, F.lit(4)), CHANNELS).alias("canal_adquisicion"),
        _pick(F.pmod(cid, F.lit(3)), RISK_BANDS).alias("banda_riesgo"),
        F.when(F.pmod(cid + F.col("mes"), F.lit(3)) == 0, dtx.cast("long"))
        .otherwise(noise).cast("int").alias("dias_ultima_interaccion"),
        (F.col("c_acctbal") > 0).alias("tiene_tarjeta_credito"),
        (F.pmod(cid, F.lit(2)) == 0).alias("activo_movil"),
        "es_nuevo_cliente",
        (F.pmod(nat, F.lit(2)) == 0).alias("tiene_prestamo"),
        F.pmod(cid * 5, F.lit(400)).cast("int").alias("antiguedad_direccion_meses"),
        F.floor(F.col("gasto") / 50000).cast("int").alias("visitas_web_ultimos_90_dias"),
        (nat * F.lit(1.5)).alias("distancia_sucursal_km"),
        _pick(F.pmod(cid, F.lit(4)), DEVICES).alias("dispositivo_principal"),
        F.least(F.dayofmonth("_first_day"), F.lit(28)).alias("dia_preferido_pago"),
        (F.pmod(cid, F.lit(5)) == 0).alias("tiene_seguro"),
        "gasto",
    )


def scores(spark: SparkSession, sf_dir: str, through: int | None = None) -> DataFrame:
    """Keys, label and three deterministic stand-in model scores in [0, 1]."""
    return with_scores(panel(spark, sf_dir, through)).select(
        "id_cliente", "mes", "objetivo", "m1", "m2", "m3")


def with_scores(df: DataFrame) -> DataFrame:
    """``m1`` is fine-grained, ``m2`` is static per customer, ``m3`` has heavy ties."""
    return df.select(
        "*",
        (F.col("gasto") / (F.col("gasto") + F.lit(100000.0))).alias("m1"),
        ((F.col("saldo_promedio") + F.lit(1000.0)) / F.lit(12000.0)).alias("m2"),
        (F.col("numero_productos") / (F.col("numero_productos") + F.lit(1.0))).alias("m3"),
    )


def valid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the rolling validation months only."""
    return scores(spark, sf_dir, max(VALID_MONTHS)).where(F.col("mes").isin(VALID_MONTHS))


def long_scores(df: DataFrame, models: list[str], keys: tuple[str, ...] = (
        "id_cliente", "mes", "objetivo")) -> DataFrame:
    return df.unpivot(list(keys), models, "model", "score")


# The same panel for the SQL side; later CTEs are appended after a comma.
PANEL_SQL = """
WITH om0 AS (
  SELECT o_custkey AS id_cliente,
         CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS mes,
         max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS objetivo,
         CAST(count(*) AS INT) AS numero_productos,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS gasto,
         min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day
  FROM orders GROUP BY 1, 2),
om1 AS (
  SELECT *, min(CASE WHEN objetivo = 1 THEN mes END) OVER (PARTITION BY id_cliente) AS ev FROM om0),
om2 AS (
  SELECT *, (mes // 100) * 12 + mes % 100 - 1 AS ord,
         date_diff('day', lag(last_day) OVER w, last_day) AS gap,
         row_number() OVER w = 1 AS es_nuevo_cliente,
         min(mes) OVER (PARTITION BY id_cliente) AS first_mes
  FROM om1 WHERE ev IS NULL OR mes <= ev WINDOW w AS (PARTITION BY id_cliente ORDER BY mes)),
panel AS (
  SELECT id_cliente, mes, objetivo,
    CAST(20 + (id_cliente * 7) % 50 AS INT) AS edad,
    round(12000 + abs(c_acctbal) * 5, 2) AS ingresos,
    ((id_cliente * 13) % 100) / 100.0::DOUBLE AS ratio_deuda_ingresos,
    CAST(ord - ((first_mes // 100) * 12 + first_mes % 100 - 1) AS INT) AS antiguedad_cuenta_meses,
    numero_productos, c_acctbal AS saldo_promedio,
    CAST(coalesce(least(gap, 364), 364) AS INT) AS dias_ultima_transaccion,
    c_mktsegment AS ocupacion, r_name AS region,
    CASE c_nationkey % 4 WHEN 0 THEN 'branch' WHEN 1 THEN 'web' WHEN 2 THEN 'app' ELSE 'referral' END AS canal_adquisicion,
    CASE id_cliente % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS banda_riesgo,
    CAST(CASE WHEN (id_cliente + mes) % 3 = 0 THEN coalesce(least(gap, 364), 364)
         ELSE 1 + (id_cliente * 31 + ord * 17) % 364 END AS INT) AS dias_ultima_interaccion,
    c_acctbal > 0 AS tiene_tarjeta_credito, id_cliente % 2 = 0 AS activo_movil, es_nuevo_cliente,
    c_nationkey % 2 = 0 AS tiene_prestamo,
    CAST((id_cliente * 5) % 400 AS INT) AS antiguedad_direccion_meses,
    CAST(floor(gasto / 50000) AS INT) AS visitas_web_ultimos_90_dias,
    c_nationkey * 1.5::DOUBLE AS distancia_sucursal_km,
    CASE id_cliente % 4 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' WHEN 2 THEN 'desktop' ELSE 'other' END AS dispositivo_principal,
    CAST(least(day(first_day), 28) AS INT) AS dia_preferido_pago,
    id_cliente % 5 = 0 AS tiene_seguro, gasto, ord
  FROM om2 JOIN customer ON id_cliente = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

SCORES_SQL = PANEL_SQL + """,
scores AS (
  SELECT *, gasto / (gasto + 100000.0::DOUBLE) AS m1,
    (saldo_promedio + 1000.0::DOUBLE) / 12000.0::DOUBLE AS m2,
    numero_productos / (numero_productos + 1.0::DOUBLE) AS m3 FROM panel),
valid AS (SELECT * FROM scores WHERE mes IN (199901, 199902, 199903)),
long AS (
  SELECT id_cliente, mes, objetivo, 'm1' AS model, m1 AS score FROM scores
  UNION ALL SELECT id_cliente, mes, objetivo, 'm2', m2 FROM scores
  UNION ALL SELECT id_cliente, mes, objetivo, 'm3', m3 FROM scores),
vlong AS (SELECT * FROM long WHERE mes IN (199901, 199902, 199903))
"""


def gini_sql(source: str, keys: str, score: str = "score", label: str = "objetivo",
             weight: str = "1", name: str = "g") -> str:
    """CTE text computing the tie-aware Gini of ``source`` per ``keys``."""
    return f"""{name}_t AS (
  SELECT {keys}, {score} AS s_, CAST(sum({weight} * {label}) AS DOUBLE) AS pos_,
         CAST(sum({weight} * (1 - {label})) AS DOUBLE) AS neg_ FROM {source} GROUP BY {keys}, {score}),
{name}_c AS (
  SELECT *, sum(neg_) OVER (PARTITION BY {keys} ORDER BY s_) - neg_ AS below_,
         sum(pos_) OVER (PARTITION BY {keys} ORDER BY s_ DESC) AS pabove_,
         sum(neg_) OVER (PARTITION BY {keys} ORDER BY s_ DESC) AS nabove_ FROM {name}_t),
{name} AS (
  SELECT {keys}, CAST(sum(pos_ + neg_) AS BIGINT) AS n_rows, CAST(sum(pos_) AS BIGINT) AS events,
         sum(pos_ * (below_ + neg_ / 2)) / nullif(sum(pos_) * sum(neg_), 0) AS auc,
         2 * (sum(pos_ * (below_ + neg_ / 2)) / nullif(sum(pos_) * sum(neg_), 0)) - 1 AS gini,
         CASE WHEN sum(neg_) > 0 THEN
           sum(pos_ * pabove_ / nullif(pabove_ + nabove_, 0)) / nullif(sum(pos_), 0) END AS ap
  FROM {name}_c GROUP BY {keys})"""
