"""Churn model: label, split, logistic regression, scores and the rule fallback."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, functions as F

from patronlens.fixed_values import (
    CHURN_DAYS,
    CHURN_FEATURES,
    LOGISTIC,
    LOGISTIC_LABEL_RULE,
    MIN_TRAINING_ROWS,
    RULE_LABEL_RULE,
    RULE_ONLY,
    TEST_SHARE,
)
from patronlens.functions.numbers import clip01
from patronlens.operators.logistic import LogisticFit, fit_logistic, probability
from patronlens.operators.quantiles import exact_quantiles

LABEL = "label_churn"
HASH_DIGITS = 13


@dataclass
class ChurnModel:
    """A fitted model, or None with the rule that replaces it.

    The metrics are computed over the test rows when they are first asked for, as scores do not
    need them. ``longest`` is the recency that the rule divides by, once it is known.
    """

    type: str
    label_rule: str
    features: tuple[str, ...]
    fitted: LogisticFit | None = None
    test: DataFrame | None = field(default=None, repr=False)
    longest: float | None = None

    @cached_property
    def _metrics(self) -> tuple[float | None, float | None]:
        if self.fitted is None or self.test is None:
            return None, None
        hit = ((F.col("p") >= 0.5).cast("double") == F.col(LABEL)).cast("double")
        scored = self.test.withColumn("p", probability(self.fitted, self.features)).select("p", LABEL)
        scored = scored.persist()
        try:
            accuracy = scored.agg(F.avg(hit)).head()[0]
            auc = BinaryClassificationEvaluator(
                rawPredictionCol="p", labelCol=LABEL, numBins=0
            ).evaluate(scored)
        finally:
            scored.unpersist()
        return auc, accuracy

    @property
    def auc(self) -> float | None:
        return self._metrics[0]

    @property
    def accuracy(self) -> float | None:
        return self._metrics[1]


def with_label(features: DataFrame, churn_days: int = CHURN_DAYS) -> DataFrame:
    return features.withColumn(LABEL, (F.col("recencyDays") >= churn_days).cast("double"))


def present_features(df: DataFrame, names: Sequence[str] = CHURN_FEATURES) -> list[str]:
    return [c for c in names if c in df.columns]


def feature_matrix(features: DataFrame, names: Sequence[str] = CHURN_FEATURES) -> DataFrame:
    """The model inputs that exist, as doubles, with missing values set to 0."""
    present = present_features(features, names)
    return features.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in present}
    )


def _key_hash() -> Column:
    """A number derived from the customer id that acts as a reproducible random draw."""
    digits = F.substring(F.md5(F.col("customer_id").cast("string").cast("binary")), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("double")


def with_split(labelled: DataFrame) -> DataFrame:
    """Add ``is_test``: a quarter of the rows of each label, rounded up.

    Rows are drawn by the hash of their id, so the split is reproducible on any cluster.
    The cut-off per label is an exact rank of the hashes, found without sorting a label's
    rows in one task.
    """
    hashed = labelled.withColumn("draw", _key_hash())
    draws = hashed.select(
        *[F.when(F.col(LABEL) == y, F.col("draw")).alias(f"y{y}") for y in (0, 1)]
    )
    found = exact_quantiles(draws, {"y0": [TEST_SHARE], "y1": [TEST_SHARE]})
    is_test = F.lit(False)
    for y in (0, 1):
        cut = found[f"y{y}"][TEST_SHARE]
        if cut is not None:
            is_test = is_test | ((F.col(LABEL) == y) & (F.col("draw") <= cut.lower))
    return hashed.withColumn("is_test", is_test).drop("draw")


def train_churn(
    features: DataFrame,
    names: Sequence[str] = CHURN_FEATURES,
    churn_days: int = CHURN_DAYS,
) -> ChurnModel:
    """Fit the model, or fall back to the rule on too little evidence.

    Pass persisted features. The driver sees row counts, sums of products of the inputs, a bounded
    sample to start from, the coefficients and the metrics. Note that recency defines the label and is also an input; leave it out through
    ``names`` for a model that predicts rather than restates the rule.
    """
    present = present_features(features, names)
    labelled = with_label(feature_matrix(features, present), churn_days)
    seen = {row[LABEL]: row["count"] for row in labelled.groupBy(LABEL).count().collect()}
    if len(seen) < 2 or sum(seen.values()) < MIN_TRAINING_ROWS:
        return ChurnModel(RULE_ONLY, RULE_LABEL_RULE, tuple(present))
    if min(seen.values()) < 2:
        raise ValueError("a stratified split needs at least two rows of each label")

    rows = with_split(labelled).select("customer_id", *present, LABEL, "is_test")
    train = rows.filter(~F.col("is_test")).drop("is_test").persist()
    try:
        fitted = fit_logistic(train, present, LABEL, "customer_id")
    finally:
        train.unpersist()
    test = rows.filter("is_test")
    return ChurnModel(LOGISTIC, LOGISTIC_LABEL_RULE, tuple(present), fitted, test)


def rule_model(features: DataFrame, names: Sequence[str] = CHURN_FEATURES) -> ChurnModel:
    """The rule without any training, for callers that only want the recency score."""
    return ChurnModel(RULE_ONLY, RULE_LABEL_RULE, tuple(present_features(features, names)))


def longest_recency(features: DataFrame) -> float:
    """The recency that stands for a risk of 1: the longest one, or 1 day if nobody has been away."""
    return features.agg(F.max(F.greatest(F.col("recencyDays"), F.lit(0)).cast("double"))).head()[0] or 1.0


def score_churn(features: DataFrame, model: ChurnModel) -> DataFrame:
    """Add ``churnRisk`` in [0, 1] to every row, training rows included.

    The rule looks for the longest recency once for each model and keeps it there, so all scores by
    one model use one base.
    """
    if model.fitted is None:
        if model.longest is None:
            model.longest = longest_recency(features)
        recency = F.greatest(F.col("recencyDays"), F.lit(0)).cast("double")
        return features.withColumn("churnRisk", clip01(recency / model.longest))
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.features]
    return features.withColumn("churnRisk", clip01(probability(model.fitted, filled)))
