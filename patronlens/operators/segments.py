"""Customer segments from quantile thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from patronlens.fixed_values import (
    AT_RISK,
    HIGH_QUANTILE,
    MID_QUANTILE,
    MODERATE,
    TOP_BUYER,
)
from patronlens.operators.anchor import Window
from patronlens.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class Thresholds:
    """Segment limits; None where there are no feature rows at all."""

    monetary_q75: float | None
    frequency_q75: float | None
    recency_q50: float | None
    recency_q75: float | None


def segment_thresholds(features: DataFrame) -> Thresholds:
    """The four exact limits over all feature rows, joined customer rows included."""
    found = exact_quantiles(
        features,
        {
            "monetary": [HIGH_QUANTILE],
            "frequency": [HIGH_QUANTILE],
            "recencyDays": [MID_QUANTILE, HIGH_QUANTILE],
        },
    )

    def limit(column: str, q: float) -> float | None:
        quantile = found[column][q]
        return quantile.value if quantile else None

    return Thresholds(
        monetary_q75=limit("monetary", HIGH_QUANTILE),
        frequency_q75=limit("frequency", HIGH_QUANTILE),
        recency_q50=limit("recencyDays", MID_QUANTILE),
        recency_q75=limit("recencyDays", HIGH_QUANTILE),
    )


def segment_of(limits: Thresholds) -> Column:
    """Segment of a feature row; a long absence outranks high spending."""
    at_risk = F.col("recencyDays") >= limits.recency_q75
    top = (
        (F.col("monetary") >= limits.monetary_q75)
        & (F.col("frequency") >= limits.frequency_q75)
        & (F.col("recencyDays") <= limits.recency_q50)
    )
    return F.when(at_risk, AT_RISK).when(top, TOP_BUYER).otherwise(MODERATE)


def with_segments(
    features: DataFrame, window: Window, limits: Thresholds | None = None
) -> DataFrame:
    """Add ``segment`` and ``isActiveInWindow``.

    Features cover every order up to the anchor, so a customer was active inside the window
    exactly when the last order is not before its start.
    """
    limits = limits or segment_thresholds(features)
    return features.withColumn("segment", segment_of(limits)).withColumn(
        "isActiveInWindow", F.col("last_order") >= window.start
    )
