"""Alerts on scored customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patronlens.fixed_values import HIGH_QUANTILE
from patronlens.operators.quantiles import exact_quantiles

# Fixed value: default minimum confidence of an alert.
ALERT_THRESHOLD = 0.75


def churn_alerts(
    scored: DataFrame, threshold: float = ALERT_THRESHOLD, high_value: float | None = None
) -> DataFrame:
    """High-value customers at churn risk, by default those in the top quarter of value."""
    if high_value is None:
        found = exact_quantiles(scored, {"monetary": [HIGH_QUANTILE]})
        limit = found["monetary"][HIGH_QUANTILE]
        high_value = limit.value if limit else 0.0
    return scored.filter(
        (F.col("monetary") >= high_value) & (F.col("churnRisk") >= threshold)
    ).select("customer_id", "segment", "monetary", "churnRisk")
