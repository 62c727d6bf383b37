import random

import numpy as np
import pytest

from patronlens.operators.quantiles import exact_quantiles

FRACTIONS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def check(spark, values, accuracy=1_000, max_ordered=50, fractions=FRACTIONS):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    found = exact_quantiles(frame, {"x": fractions}, accuracy, max_ordered)["x"]
    known = np.array([v for v in values if v is not None])
    for q in fractions:
        assert found[q].rows == len(known)
        assert found[q].value == pytest.approx(np.quantile(known, q), rel=1e-15, abs=1e-15)
        assert found[q].lower == np.quantile(known, q, method="lower")


SHAPES = {
    "single": [3.5],
    "two": [1.0, 2.0],
    "with nulls": [None, 4.0, None, 1.0, 9.0],
    "constant": [7.0] * 500,
    "hot value": [5.0] * 400 + [float(i) for i in range(200)],
    "heavy tail": [1.5**i for i in range(200)] + [-(1.5**i) for i in range(200)],
    "few values": [float(i % 7) for i in range(1000)],
    "mixed": [random.Random(1).gauss(0, 1000) for _ in range(3000)],
}


@pytest.mark.parametrize("max_ordered", [50, 200_000])
@pytest.mark.parametrize("shape", SHAPES)
def test_matches_numpy(spark, shape, max_ordered):
    check(spark, SHAPES[shape], max_ordered=max_ordered)


@pytest.mark.parametrize("shape", ["constant", "hot value", "mixed"])
def test_narrowing_down_to_a_single_value(spark, shape):
    check(spark, SHAPES[shape], max_ordered=1, fractions=[0.3])


@pytest.mark.parametrize("accuracy", [5, 20])
def test_coarse_sketch_never_changes_the_result(spark, accuracy):
    rng = random.Random(accuracy)
    values = [rng.expovariate(0.01) for _ in range(2000)]
    check(spark, values, accuracy, fractions=[0.25, 0.75])


def test_many_columns_and_empty_column(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=1500), rng.integers(0, 40, size=1500)
    frame = spark.createDataFrame(
        [(float(x), int(y), None) for x, y in zip(a, b)], "a double, b int, c double"
    )
    found = exact_quantiles(frame, {"a": [0.75], "b": [0.5, 0.75], "c": [0.5]})
    assert found["a"][0.75].value == pytest.approx(np.quantile(a, 0.75), rel=1e-15)
    assert found["b"][0.5].value == np.quantile(b, 0.5)
    assert found["b"][0.75].value == np.quantile(b, 0.75)
    assert found["c"][0.5] is None
