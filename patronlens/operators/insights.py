"""Rule-based insights, grounding facts and the model record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patronlens import fixed_values as fixed
from patronlens.functions.text import fixed_text, percent_text
from patronlens.operators.churn import ChurnModel

INSIGHT_COLUMNS = ["title", "severity", "evidence", "recommendedAction"]


def at_risk_insight(features: DataFrame) -> DataFrame:
    """One row when the at-risk share reaches the warning level, else none."""
    is_at_risk = (F.col("segment") == fixed.AT_RISK).cast("double")
    share = F.col("share")
    return (
        features.agg(F.coalesce(F.avg(is_at_risk), F.lit(0.0)).alias("share"))
        .filter(share >= fixed.AT_RISK_SHARE)
        .select(
            F.lit(fixed.AT_RISK_TITLE).alias("title"),
            F.lit("warning").alias("severity"),
            F.format_string(fixed.AT_RISK_EVIDENCE, percent_text(share, 0)).alias("evidence"),
            F.lit(fixed.AT_RISK_ACTION).alias("recommendedAction"),
        )
    )


def test_insights(tests: DataFrame) -> DataFrame:
    """One row per significant test."""
    return tests.filter(F.col("result") == "significant").select(
        F.lit(fixed.TEST_TITLE).alias("title"),
        F.lit("info").alias("severity"),
        F.format_string(
            fixed.TEST_EVIDENCE, F.col("name"), fixed_text(F.col("pValue"), 4)
        ).alias("evidence"),
        F.lit(fixed.TEST_ACTION).alias("recommendedAction"),
        F.col("name").alias("_test"),
    )


test_insights.__test__ = False  # not a unit test, whatever its name suggests


def test_position(names: Sequence[str], name: Column) -> Column:
    """Place of a test in the order given; tests that are not listed come last."""
    listed = F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), name)
    return F.when(listed > 0, listed).otherwise(len(names) + 1)


test_position.__test__ = False


def insights(features: DataFrame, tests: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Ranked insights: the at-risk warning first, then tests in order, six rows at most."""
    first = at_risk_insight(features).select(
        "*", F.lit(0).cast("long").alias("_rank"), F.lit("").alias("_test")
    )
    place = test_position(order, F.col("_test")).cast("long")
    rest = test_insights(tests).select(*INSIGHT_COLUMNS, place.alias("_rank"), "_test")
    return (
        first.unionByName(rest)
        .orderBy("_rank", "_test")
        .limit(fixed.MAX_INSIGHTS)
        .select(*INSIGHT_COLUMNS)
    )


def facts(kpis: DataFrame, model: ChurnModel) -> DataFrame:
    """One row ``facts``: three sentences, and a fourth when the model has an AUC."""
    texts = [
        F.format_string(fixed.ACTIVE_FACT, F.col("activeCustomers").cast("string")),
        F.format_string(fixed.RETENTION_FACT, percent_text(F.col("retentionRate"), 1)),
        F.format_string(fixed.CHURN_FACT, F.col("churnRiskCustomers").cast("string")),
    ]
    if model.auc is not None:
        texts.append(F.format_string(fixed.AUC_FACT, fixed_text(F.lit(model.auc), 2)))
    return kpis.select(F.array(texts).alias("facts"))


def model_record(spark: SparkSession, model: ChurnModel) -> DataFrame:
    """One row describing the churn model."""
    metrics = F.struct(
        F.lit(model.auc).cast("double").alias("auc"),
        F.lit(model.accuracy).cast("double").alias("accuracy"),
    )
    return spark.range(1).select(
        F.lit(model.type).alias("type"),
        F.lit(model.label_rule).alias("labelRule"),
        F.array([F.lit(c) for c in model.features]).alias("features"),
        metrics.alias("metrics"),
    )
