import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from patronlens.fixed_values import CHURN_FEATURES
from patronlens.operators import churn, logistic
from patronlens.operators.alerts import churn_alerts


def frame(spark, n, seed=1, low=0, high=200):
    rng = np.random.default_rng(seed)
    rows = [
        (f"c{i}", int(rng.integers(low, high)), int(rng.integers(0, 5)), float(rng.gamma(2, 50)),
         float(rng.normal(10, 3)) if i % 4 else None, float(rng.integers(0, 9)))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "customer_id string, recencyDays int, frequency90d bigint, monetary90d double,"
        " avg_session_time_min double, wishlist_items_count double",
    )


def newton(x, y):
    """Minimise summed log-loss plus half the squared weights, intercept unpenalised."""
    design = np.column_stack([x, np.ones(len(x))])
    scale = np.append(np.abs(x).max(axis=0), 1.0)
    z = design / scale
    penalty = np.append(1 / scale[:-1] ** 2, 0.0)
    w = np.zeros(z.shape[1])

    def loss(w):
        margin = z @ w
        return np.logaddexp(0, margin).sum() - y @ margin + 0.5 * (penalty * w**2).sum()

    for _ in range(500):
        p = 1 / (1 + np.exp(-(z @ w)))
        gradient = z.T @ (p - y) + penalty * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step, size = np.linalg.solve(hessian + 1e-12 * np.eye(len(w)), gradient), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-8:
            size /= 2
        w = w - size * step
        if np.abs(gradient).max() < 1e-10:
            break
    return w / scale


def test_rule_replaces_the_model_on_little_evidence(spark):
    for rows in (frame(spark, 49), frame(spark, 60, high=60), frame(spark, 60, low=60)):
        model = churn.train_churn(rows)
        assert (model.type, model.auc, model.accuracy) == ("rule_only", None, None)
        assert model.label_rule == "churned if recencyDays >= 60"
        assert model.features == tuple(CHURN_FEATURES)


def test_rule_score(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 5), ("c", 20)], "customer_id string, recencyDays int")
    scored = churn.score_churn(rows, churn.rule_model(rows))
    assert {r["customer_id"]: r["churnRisk"] for r in scored.collect()} == {"a": 0, "b": 0.25, "c": 1}


def test_rule_score_without_any_age(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 0)], "customer_id string, recencyDays int")
    scored = churn.score_churn(rows, churn.rule_model(rows))
    assert [r["churnRisk"] for r in scored.collect()] == [0.0, 0.0]


def test_split_takes_a_quarter_of_each_label(spark):
    labelled = churn.with_label(frame(spark, 203))
    rows = churn.with_split(labelled).groupBy(churn.LABEL).agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("test")
    )
    for r in rows.collect():
        assert r["test"] == -(-r["n"] // 4)


def test_split_does_not_depend_on_partitions(spark):
    labelled = churn.with_label(frame(spark, 150))
    one = {r["customer_id"]: r["is_test"] for r in churn.with_split(labelled.coalesce(1)).collect()}
    many = churn.with_split(labelled.repartition(13)).collect()
    assert one == {r["customer_id"]: r["is_test"] for r in many}


def test_model_reaches_the_independent_optimum(spark):
    rows = frame(spark, 400)
    # Recency is left out, so that the classes overlap and the optimum is well conditioned.
    names = CHURN_FEATURES[1:]
    model = churn.train_churn(rows, names)
    train = churn.with_split(churn.with_label(churn.feature_matrix(rows))).filter("NOT is_test")
    data = np.array([tuple(r) for r in train.select(*names, churn.LABEL).collect()])
    expected = newton(data[:, :-1], data[:, -1])
    assert model.fitted.coefficients.toArray() == pytest.approx(expected[:-1], rel=2e-3, abs=1e-5)
    assert model.fitted.intercept == pytest.approx(expected[-1], rel=2e-3)
    assert model.label_rule == "churned if no purchase in last 60 days"


def test_metrics_match_direct_computation(spark):
    rows = frame(spark, 400, seed=4)
    model = churn.train_churn(rows, CHURN_FEATURES[1:])
    scored = churn.with_split(churn.with_label(churn.score_churn(rows, model))).filter("is_test")
    pairs = [(r["churnRisk"], r[churn.LABEL]) for r in scored.collect()]
    positive = [p for p, y in pairs if y == 1]
    negative = [p for p, y in pairs if y == 0]
    wins = sum((p > q) + 0.5 * (p == q) for p in positive for q in negative)
    assert model.auc == pytest.approx(wins / len(positive) / len(negative), abs=1e-12)
    hits = sum((p >= 0.5) == (y == 1) for p, y in pairs)
    assert model.accuracy == pytest.approx(hits / len(pairs))


def test_scores_cover_all_rows_and_keep_columns(spark):
    rows = frame(spark, 300, seed=2)
    model = churn.train_churn(rows)
    scored = churn.score_churn(rows, model)
    assert scored.columns == [*rows.columns, "churnRisk"]
    risks = scored.collect()
    assert len(risks) == 300 and all(0 <= r["churnRisk"] <= 1 for r in risks)
    assert sum(r["avg_session_time_min"] is None for r in risks) == 75
    assert model.auc > 0.99  # recency is both label and input


def test_split_needs_two_rows_of_each_label(spark):
    rows = frame(spark, 60, high=59).unionByName(
        frame(spark, 1, low=100, high=101).withColumn("customer_id", F.lit("old"))
    )
    with pytest.raises(ValueError, match="at least two rows"):
        churn.train_churn(rows)


def test_alerts_need_value_and_risk(spark):
    rows = [(f"c{i}", "s", float(i), r) for i, r in enumerate([0.9] * 8 + [0.75, 0.74, 0.8, 0.1])]
    scored = spark.createDataFrame(
        rows, "customer_id string, segment string, monetary double, churnRisk double"
    )
    # The upper quartile of 0..11 is 8.25.
    assert {r["customer_id"] for r in churn_alerts(scored).collect()} == {"c10"}
    assert churn_alerts(scored, threshold=0.05, high_value=9).count() == 3


def spark_fit(rows, names):
    """Spark's own fit of the same loss, as an independent check."""
    n = rows.count()
    vectors = VectorAssembler(inputCols=list(names), outputCol="x").transform(rows)
    return LogisticRegression(
        featuresCol="x", labelCol="y", regParam=1 / n, maxIter=1000, tol=1e-12, standardization=False
    ).fit(vectors)


def overlapping(spark, n, seed=5):
    """Inputs of very different sizes, and labels that they only half explain."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(0, 1, n), rng.gamma(2, 5e4, n), rng.integers(0, 3, n) * 1e-3])
    y = (x[:, 0] + x[:, 1] / 1e5 + rng.logistic(0, 1.5, n) > 1).astype(float)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double"), x, y


@pytest.mark.parametrize("start", [100, 20_000])
def test_newton_passes_are_few_and_reach_the_optimum(spark, monkeypatch, start):
    monkeypatch.setattr(logistic, "START_ROWS", start)
    rows, x, y = overlapping(spark, 4000)
    fit = logistic.fit_logistic(rows, ["a", "b", "c"], "y", "id")
    expected = newton(x, y)
    assert [*fit.coefficients, fit.intercept] == pytest.approx(expected, rel=1e-8, abs=1e-10)
    other = spark_fit(rows, ["a", "b", "c"])
    assert fit.coefficients.toArray()[:2] == pytest.approx(other.coefficients.toArray()[:2], rel=1e-3)
    assert fit.passes < 12


def test_newton_halves_steps_from_a_misleading_start(spark, monkeypatch):
    """A start far off the optimum: full steps would overshoot."""
    rows, x, y = overlapping(spark, 600)
    monkeypatch.setattr(logistic, "_on_sample", lambda data, share: np.array([8.0, 1e-4, 0.0, -20.0]))
    fit = logistic.fit_logistic(rows, ["a", "b", "c"], "y", "id")
    assert [*fit.coefficients, fit.intercept] == pytest.approx(newton(x, y), rel=1e-8, abs=1e-10)


def test_label_that_an_input_restates(spark):
    """Separable classes: only the penalty keeps the optimum finite."""
    rows = churn.feature_matrix(frame(spark, 3000, seed=9))
    fit = churn.train_churn(rows).fitted
    train = churn.with_split(churn.with_label(rows)).filter("NOT is_test")
    data = np.array([tuple(r) for r in train.select(*CHURN_FEATURES, churn.LABEL).collect()])
    assert [*fit.coefficients, fit.intercept] == pytest.approx(newton(data[:, :-1], data[:, -1]), rel=1e-5, abs=1e-8)
    assert fit.passes < 12


def test_longest_recency_is_found_once_for_a_model(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 5), ("c", 20)], "customer_id string, recencyDays int")
    model = churn.rule_model(rows)
    churn.score_churn(rows, model)
    assert model.longest == 20
    part = churn.score_churn(rows.filter("recencyDays < 20"), model).collect()
    assert {r["customer_id"]: r["churnRisk"] for r in part} == {"a": 0, "b": 0.25}
