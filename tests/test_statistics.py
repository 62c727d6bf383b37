import math

import numpy as np
import pytest

from patronlens.functions.fdist import f_upper_tail, incomplete_beta
from patronlens.operators.anova import group_moments, one_way_anova, run_tests, test_records as records

TEST = {"t": ("x", "g")}


def anova(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    frame = spark.createDataFrame(rows, "g string, x double")
    return one_way_anova(group_moments(frame, TEST))


def test_table_value():
    assert f_upper_tail(3.354131, 2, 27) == pytest.approx(0.05, abs=1e-6)


def test_tail_does_not_underflow():
    assert 1e-127 < f_upper_tail(200, 4, 1000) < 1e-125


@pytest.mark.parametrize(("d1", "d2"), [(2, 5), (4, 90), (24, 700), (6, 3)])
def test_even_degrees_have_a_closed_form(d1, d2):
    for f in (0.1, 0.9, 1.0, 2.5, 12.0):
        x, a = d2 / (d2 + d1 * f), d2 / 2
        term, total = 1.0, 0.0
        for j in range(d1 // 2):
            total += term
            term *= (a + j) / (j + 1) * (1 - x)
        assert f_upper_tail(f, d1, d2) == pytest.approx(x**a * total, rel=1e-12)


def test_beta_symmetry_and_limits():
    assert incomplete_beta(0, 2, 3) == 0 and incomplete_beta(1, 2, 3) == 1
    for x in (0.01, 0.3, 0.5, 0.9):
        assert incomplete_beta(x, 2.5, 4) == pytest.approx(1 - incomplete_beta(1 - x, 4, 2.5), abs=1e-14)
        assert incomplete_beta(x, 1, 1) == pytest.approx(x)


def test_f_matches_direct_sums(spark):
    rng = np.random.default_rng(3)
    groups = {g: rng.normal(m, 2, size=n) for g, m, n in (("a", 0, 8), ("b", 1, 13), ("c", 3, 5))}
    everything = np.concatenate(list(groups.values()))
    between = sum(len(v) * (v.mean() - everything.mean()) ** 2 for v in groups.values())
    within = sum(((v - v.mean()) ** 2).sum() for v in groups.values())
    row = anova(spark, groups).head()
    assert row["f"] == pytest.approx((between / 2) / (within / 23), rel=1e-12)
    assert row["p"] == pytest.approx(f_upper_tail(row["f"], 2, 23))


@pytest.mark.parametrize(
    "groups", [{"a": [1, 2, 3, 4, 5]}, {"a": [1, 2, 3, 4, 5], "b": [1, 2, 3, 4]}]
)
def test_too_few_groups_or_rows_give_no_record(spark, groups):
    assert anova(spark, groups).count() == 0


def test_no_spread_inside_groups(spark):
    differing = records(anova(spark, {"a": [1] * 5, "b": [2] * 5})).head()
    assert (differing["pValue"], differing["result"]) == (0.0, "significant")
    equal = records(anova(spark, {"a": [1] * 5, "b": [1] * 5})).head()
    assert (equal["pValue"], equal["result"]) == (None, "not_significant")


def test_customers_without_device_or_orders_take_no_part(spark, transactions, customers):
    ids = [f"c{i}" for i in range(12)]
    orders = transactions([(i, i, "2024-01-01", 10 + n) for n, i in enumerate(ids)])
    known = customers(
        [(i, None, "x" if n < 5 else "y" if n < 10 else None) for n, i in enumerate(ids)]
        + [("idle", None, "x")]
    )
    row = run_tests(known, orders).head()
    assert row["name"] == "Avg order value differs by device_type"
    assert row["method"] == "ANOVA"
    # Group means 12 and 17, sum of squares 10 inside each group: F = 62.5 / 2.5.
    assert row["pValue"] == pytest.approx(f_upper_tail(25.0, 1, 8))
    assert math.isclose(row["pValue"], 0.00105282, rel_tol=1e-4)
