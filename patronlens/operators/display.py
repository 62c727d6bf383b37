"""Display columns derived from the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patronlens.fixed_values import HIGH_RISK, KPI_DELTA_LABELS, MEDIUM_RISK, TOP_BUYER
from patronlens.functions.numbers import clamp01, finite
from patronlens.functions.text import grouped_whole, percent_text


def delta_direction(delta: Column) -> Column:
    known = finite(delta.cast("double"))
    return F.when(known > 0, "up").when(known < 0, "down").otherwise("none")


def delta_text(delta: Column) -> Column:
    """Signed percent with one decimal; no text without a value."""
    known = finite(delta.cast("double"))
    digits = percent_text(F.abs(known), 1, ties="up")
    return (
        F.when(known.isNull(), "")
        .when(known > 0, F.concat(F.lit("+"), digits, F.lit("%")))
        .when(known < 0, F.concat(F.lit("-"), digits, F.lit("%")))
        .otherwise("0.0%")
    )


def churn_band(risk: Column) -> Column:
    """Strict limits, unlike the churn KPI, which includes its limit."""
    return F.when(risk > HIGH_RISK, "high").when(risk > MEDIUM_RISK, "medium").otherwise("low")


def segment_label(segment: Column) -> Column:
    return F.when(segment == TOP_BUYER, "Top Buyers").otherwise(segment)


def money_text(value: Column) -> Column:
    return F.concat(F.lit("$"), grouped_whole(value))


def share_text(share: Column, digits: int) -> Column:
    return F.concat(percent_text(share, digits, ties="up"), F.lit("%"))


def top_customers_display(top: DataFrame) -> DataFrame:
    churn = clamp01(F.col("churnRisk"))
    return top.select(
        "id",
        "name",
        "segment",
        F.format_string("%d days", F.col("recencyDays")).alias("recency"),
        "frequency",
        money_text(F.col("monetary")).alias("monetary"),
        churn.alias("churn"),
        churn_band(churn).alias("churn_band"),
        share_text(churn, 0).alias("churn_text"),
    )


def kpi_display(kpis: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Rows (kpi, text, direction, delta_text, label); no deltas unless changes are given."""
    texts = {
        "activeCustomers": F.format_number("activeCustomers", 0),
        "avgCustomerValue": money_text(F.col("avgCustomerValue")),
        "churnRiskCustomers": F.format_number("churnRiskCustomers", 0),
        "retentionRate": share_text(F.col("retentionRate"), 1),
    }
    cards = kpis.select(
        F.inline(
            F.array(
                [
                    F.struct(
                        F.lit(name).alias("kpi"),
                        text.alias("text"),
                        F.lit(KPI_DELTA_LABELS[name]).alias("label"),
                    )
                    for name, text in texts.items()
                ]
            )
        )
    )
    if changes is None:
        cards = cards.withColumn("deltaPct", F.lit(None).cast("double"))
    else:
        cards = cards.join(changes.select("kpi", "deltaPct"), "kpi", "left")
    delta = F.col("deltaPct")
    return cards.select(
        "kpi",
        "text",
        delta_direction(delta).alias("direction"),
        delta_text(delta).alias("delta_text"),
        "label",
    )


def segment_display(counts: DataFrame) -> DataFrame:
    return counts.select(segment_label(F.col("name")).alias("name"), "value")
