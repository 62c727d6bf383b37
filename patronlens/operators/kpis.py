"""Headline figures, segment sizes, value trend and top customers over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patronlens.fixed_values import HIGH_RISK, TOP_CUSTOMERS, TREND_MONTHS
from patronlens.functions.dates import month_label
from patronlens.functions.numbers import relative_change


def kpis(scored: DataFrame) -> DataFrame:
    """One row; all four figures come from a single aggregate."""
    repeat = (F.col("frequency") >= 2).cast("double")
    return scored.agg(
        F.count_if("isActiveInWindow").alias("activeCustomers"),
        F.coalesce(F.avg("monetary"), F.lit(0.0)).alias("avgCustomerValue"),
        F.count_if(F.col("churnRisk") >= HIGH_RISK).alias("churnRiskCustomers"),
        F.coalesce(F.avg(repeat), F.lit(0.0)).alias("retentionRate"),
    )


def segment_counts(features: DataFrame) -> DataFrame:
    """Customers per segment, by name; empty segments do not appear."""
    return (
        features.groupBy(F.col("segment").alias("name"))
        .agg(F.count("customer_id").alias("value"))
        .orderBy("name")
    )


def clv_trend(features: DataFrame, months: int = TREND_MONTHS) -> DataFrame:
    """Mean lifetime value per month of the customers whose last order fell into it."""
    return (
        features.groupBy(month_label(F.col("last_order")).alias("month"))
        .agg(F.avg("monetary").alias("value"))
        .orderBy(F.desc("month"))
        .limit(months)
        .orderBy("month")
    )


def top_customers(scored: DataFrame, k: int = TOP_CUSTOMERS) -> DataFrame:
    """The k customers with the highest lifetime value; equal values rank by id."""
    key = F.col("customer_id")
    name = F.col("name") if "name" in scored.columns else F.lit(None).cast("string")
    return (
        scored.orderBy(F.desc("monetary"), key)
        .limit(k)
        .select(
            key.cast("string").alias("id"),
            F.coalesce(name, key.cast("string")).alias("name"),
            "segment",
            F.col("recencyDays").cast("bigint").alias("recencyDays"),
            F.col("frequency").cast("bigint").alias("frequency"),
            "monetary",
            "churnRisk",
        )
    )


def kpi_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows (kpi, value, previous, deltaPct) from two one-row KPI tables."""

    def as_rows(frame: DataFrame, value: str) -> DataFrame:
        wide = frame.select([F.col(c).cast("double").alias(c) for c in frame.columns])
        return wide.unpivot([], wide.columns, "kpi", value)

    return as_rows(current, "value").join(as_rows(previous, "previous"), "kpi").withColumn(
        "deltaPct", relative_change(F.col("value"), F.col("previous"))
    )


def retention_by_segment(features: DataFrame) -> DataFrame:
    """Share of repeat customers in each segment."""
    repeat = (F.col("frequency") >= 2).cast("double")
    return features.groupBy("segment").agg(
        F.count("*").alias("customers"), F.avg(repeat).alias("retentionRate")
    )
