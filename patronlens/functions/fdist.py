"""Upper tail of the F distribution, needed for p-values that keep their tiny tails."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship this module's code with the function, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 1001):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            change = c * d
            result *= change
        if abs(change - 1.0) < 1e-15:
            break
    return result


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1.0 - x, b, a) / b


def f_upper_tail(f: float, d1: float, d2: float) -> float | None:
    """P(F > f); the beta form does not underflow where 1 - cdf would."""
    if f is None or math.isnan(f):
        return None
    if math.isinf(f):
        return 0.0
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """One p-value per row of a table of tests (one row per test, so tiny)."""
    return pd.Series(
        [f_upper_tail(*row) for row in zip(f.astype(float), d1, d2)], dtype="float64"
    )
