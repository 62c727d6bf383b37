"""Sales over time: weekly forecast, revenue trend, monthly and weekday figures, growth."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from patronlens.functions.dates import month_label, week_start
from patronlens.functions.numbers import relative_change

# Forecast shape and growth window.
FORECAST_BASE_WEEKS = 4
SHOWN_WEEKS = 6
FUTURE_WEEKS = 2
FORECAST_DAYS = 30
GROWTH_DAYS = 30


def _moment(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def weekly_forecast(sales: DataFrame, anchor: datetime) -> DataFrame:
    """Six weeks around the anchor week: four with actual revenue and two ahead.

    The forecast is the mean of the known actuals of the four weeks before. Only the weeks
    that matter are read, and the window without partitions runs over ten weekly rows.
    """
    monday = anchor - timedelta(days=anchor.weekday())
    known = SHOWN_WEEKS - FUTURE_WEEKS
    first = monday - timedelta(weeks=known + FORECAST_BASE_WEEKS - 1)
    sold = F.col("sold_at")
    read = (sold >= _moment(first)) & (sold < _moment(monday + timedelta(weeks=1)))
    weekly = sales.filter(read).groupBy(week_start(sold).alias("week")).agg(
        F.sum("revenue").alias("actual")
    )
    position = F.col("id").cast("int")
    calendar = sales.sparkSession.range(FORECAST_BASE_WEEKS + SHOWN_WEEKS).select(
        position.alias("position"),
        F.date_add(F.lit(first.date()), position * 7).alias("week"),
    )
    before = W.orderBy("position").rowsBetween(-FORECAST_BASE_WEEKS, -1)
    return (
        calendar.join(weekly, "week", "left")
        .withColumn("forecast", F.avg("actual").over(before))
        .filter(F.col("position") >= FORECAST_BASE_WEEKS)
        .select("week", "actual", "forecast")
    )


def revenue_forecast(sales: DataFrame, days: int = FORECAST_DAYS) -> DataFrame:
    """One row: linear trend of daily revenue and the sum it gives for the next days."""
    daily = sales.groupBy(F.col("sold_at").cast("date").alias("day")).agg(
        F.sum("revenue").alias("revenue")
    )
    # Days are counted from a fixed date, as the regression needs numbers.
    x = F.date_diff("day", F.lit("1970-01-01").cast("date")).cast("double")
    steps = days * (days + 1) / 2
    slope, intercept = F.col("slope"), F.col("intercept")
    return (
        daily.agg(
            F.max("day").alias("last_day"),
            F.regr_slope("revenue", x).alias("slope"),
            F.regr_intercept("revenue", x).alias("intercept"),
            F.max(x).alias("last_x"),
        )
        .withColumn("forecast", days * (intercept + slope * F.col("last_x")) + slope * steps)
        .select("last_day", "slope", "forecast")
    )


def monthly_figures(transactions: DataFrame) -> DataFrame:
    """Distinct customers and revenue per month."""
    month = month_label(F.col("order_datetime")).alias("month")
    # Through (month, customer) grain: both figures come from one pass without Expand.
    return (
        transactions.groupBy(month, "customer_id")
        .agg(F.sum("total_amount").alias("revenue"))
        .groupBy("month")
        .agg(F.count("*").alias("users"), F.sum("revenue").alias("revenue"))
    )


def visits_per_weekday(visits: DataFrame, ts: str) -> DataFrame:
    """Visits per weekday, Monday first."""
    day = F.weekday(F.col(ts).cast("date"))
    return (
        visits.groupBy(day.alias("position"))
        .agg(F.count("*").alias("visits"))
        .withColumn("weekday", F.date_format(F.date_add(F.lit("2024-01-01"), F.col("position")), "EEE"))
        .select("position", "weekday", "visits")
    )


def share_by(df: DataFrame, dimension: str) -> DataFrame:
    """Rows per value of a dimension and their share."""
    groups = df.groupBy(F.col(dimension).alias("name")).agg(F.count("*").alias("n"))
    total = groups.agg(F.sum("n").alias("n")).scalar()
    return groups.withColumn("share", F.col("n") / total)


def growth(sales: DataFrame, key: str, anchor: datetime, days: int = GROWTH_DAYS) -> DataFrame:
    """Revenue of the last days, of the days before them, and the relative change per key."""
    day_after = anchor + timedelta(days=1)
    middle, first = day_after - timedelta(days=days), day_after - timedelta(days=2 * days)
    sold = F.col("sold_at")
    recent = F.when(sold >= _moment(middle), F.col("revenue")).otherwise(0.0)
    earlier = F.when(sold < _moment(middle), F.col("revenue")).otherwise(0.0)
    return (
        sales.filter((sold >= _moment(first)) & (sold < _moment(day_after)))
        .groupBy(key)
        .agg(F.sum(recent).alias("current"), F.sum(earlier).alias("previous"))
        .withColumn("growth", relative_change(F.col("current"), F.col("previous")))
    )


def trending(grown: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The k keys with the strongest growth; keys without earlier revenue have none."""
    return grown.filter(F.col("growth").isNotNull()).orderBy(F.desc("growth"), key).limit(k)
