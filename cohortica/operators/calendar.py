"""Calendar features of a pay day, through a small date dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The sixteen national public holidays of 2026.
HOLIDAYS_2026 = [
    "2026-01-01", "2026-04-02", "2026-04-03", "2026-05-01", "2026-06-07", "2026-06-29",
    "2026-07-23", "2026-07-28", "2026-07-29", "2026-08-06", "2026-08-30", "2026-10-08",
    "2026-11-01", "2026-12-08", "2026-12-09", "2026-12-25",
]
# Months of the legal bonus and of the deposit.
BONUS_MONTHS = [7, 12]
DEPOSIT_MONTHS = [5, 11]


def holiday_table(spark: SparkSession, days: Sequence[str] = HOLIDAYS_2026) -> DataFrame:
    return spark.createDataFrame([(d,) for d in days], "day string").select(F.to_date("day").alias("day"))


def date_dimension(spark: SparkSession, first_year: int, last_year: int,
                   holidays: DataFrame) -> DataFrame:
    """One row per day with weekday, holiday, business-day and month columns.

    Some days past the last month are generated so the next business day of its
    end is known. A few hundred rows per year, whatever the panel size.
    """
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(f"{first_year}-01-01").cast("date"),
        F.date_add(F.lit(f"{last_year}-12-31").cast("date"), 31))).alias("day"))
    marked = days.join(holidays.withColumn("_h", F.lit(1)), "day", "left").select(
        "day", F.weekday("day").alias("pay_weekday"),
        F.coalesce(F.col("_h"), F.lit(0)).alias("pay_is_holiday"))
    weekend = (F.col("pay_weekday") >= 5).cast("int")
    business = ((F.col("pay_weekday") < 5) & (F.col("pay_is_holiday") == 0)).cast("int")
    flagged = marked.select("*", weekend.alias("pay_is_weekend"), business.alias("_business"))
    onward = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    month = Window.partitionBy(F.year("day"), F.month("day"))
    next_business = F.min(F.when(F.col("_business") == 1, F.col("day"))).over(onward)
    return flagged.select(
        (F.year("day") * 100 + F.month("day")).alias("_period"), F.dayofmonth("day").alias("_day"),
        "pay_weekday", "pay_is_weekend", "pay_is_holiday",
        F.datediff(next_business, "day").alias("pay_days_to_business_day"),
        F.sum("_business").over(month).cast("int").alias("month_business_days"),
        F.sum("pay_is_holiday").over(month).cast("int").alias("month_holidays"),
        F.dayofmonth(F.last_day("day")).alias("month_days"),
    ).where(F.floor(F.col("_period") / 100) <= last_year)


def calendar_flags(period: Column) -> dict[str, Column]:
    """Bonus and deposit month flags."""
    month = F.pmod(period, F.lit(100))
    return {"gratificacion_month": month.isin(BONUS_MONTHS).cast("int"),
            "cts_month": month.isin(DEPOSIT_MONTHS).cast("int")}


def holiday_coverage(df: DataFrame, period: str, year: int) -> DataFrame:
    """Rows whose period lies outside the holiday table's year."""
    outside = F.floor(F.col(period) / 100) != year
    return df.agg(F.coalesce(F.sum(outside.cast("long")), F.lit(0)).alias("uncovered_rows"))


def add_calendar(df: DataFrame, period: str, day: str, year: int = 2026,
                 holidays: DataFrame | None = None, flags: bool = False) -> DataFrame:
    """Join the date dimension on (period, day); bad dates and other years fail the query."""
    spark = df.sparkSession
    dim = date_dimension(spark, year, year, holidays if holidays is not None else holiday_table(spark))
    joined = df.join(F.broadcast(dim), (F.col(period) == F.col("_period")) & (F.col(day) == F.col("_day")), "left")
    checked = F.when(F.col("pay_weekday").isNull(), F.raise_error(
        F.lit("a date is invalid or outside the holiday table")).cast("int")).otherwise(F.col("pay_weekday"))
    out = joined.withColumn("pay_weekday", checked).drop("_period", "_day")
    for name, expr in (calendar_flags(F.col(period)) if flags else {}).items():
        out = out.withColumn(name, expr)
    return out
