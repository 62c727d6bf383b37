"""Logistic regression by Newton steps, each of them one aggregate over the rows.

The loss is the summed log-loss plus half the squared coefficients, the intercept left out. A pass adds
up loss, gradient and second derivatives (a few dozen sums, combined before they are shuffled), and the
driver solves a system of the size of the inputs. The first point comes from a fit on a sample of at most
``START_ROWS`` rows, chosen by hash of their key; it only saves passes, since the result is the
optimum over all rows. A step that raises the loss is halved.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, functions as F

START_ROWS = 20_000
MAX_PASSES = 100
TOLERANCE = 1e-9  # expected fall of the loss, below which a last step is taken unseen


@dataclass(frozen=True)
class LogisticFit:
    """Coefficients in the order of the inputs, the intercept, and the passes over all rows."""

    coefficients: DenseVector
    intercept: float
    passes: int


def _margin(weights: Sequence[float], inputs: Sequence[Column | str]) -> Column:
    """Intercept last."""
    total = F.lit(float(weights[-1]))
    for weight, x in zip(weights, inputs):
        total = total + F.lit(float(weight)) * (F.col(x) if isinstance(x, str) else x)
    return total


def probability(fit: LogisticFit, inputs: Sequence[Column | str]) -> Column:
    """The probability of label 1, as a plain expression."""
    return 1 / (1 + F.exp(-_margin([*fit.coefficients, fit.intercept], inputs)))


def _sums(rows: DataFrame, names: Sequence[str], label: str, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-loss, its gradient and its second derivatives over all rows, in one aggregate."""
    xs, y = [*(F.col(n) for n in names), F.lit(1.0)], F.col(label)
    m = _margin(weights, names)
    p = 1 / (1 + F.exp(-m))
    size = len(xs)
    corners = [(i, j) for i in range(size) for j in range(i + 1)]
    found = rows.select(*names, label, m.alias("_m"), p.alias("_p")).agg(
        F.sum(F.log1p(F.exp(-F.abs("_m"))) + F.greatest(F.col("_m"), F.lit(0.0)) - y * F.col("_m")),
        *[F.sum((F.col("_p") - y) * x) for x in xs],
        *[F.sum(F.col("_p") * (1 - F.col("_p")) * xs[i] * xs[j]) for i, j in corners],
    ).head()
    second = np.zeros((size, size))
    for (i, j), value in zip(corners, found[1 + size :]):
        second[i, j] = second[j, i] = value
    return found[0], np.array(found[1 : 1 + size]), second


def _step(gradient: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The Newton step, solved after the unknowns are scaled to the same size."""
    scale = 1 / np.sqrt(np.maximum(np.diag(second), 1e-300))
    scaled = second * np.outer(scale, scale) + 1e-14 * np.eye(len(scale))
    return -scale * np.linalg.solve(scaled, scale * gradient)


def _descend(measure, weights: np.ndarray, share: float) -> tuple[np.ndarray, int]:
    """Newton steps from ``weights``; ``measure`` gives the sums, of which rows hold ``share``."""
    penalty = np.append(np.ones(len(weights) - 1), 0.0)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, gradient, second = measure(w)
        half = 0.5 * float(penalty @ w**2)
        return loss / share + half, gradient / share + penalty * w, second / share + np.diag(penalty)

    here, passes = at(weights), 1
    while True:
        step = _step(here[1], here[2])
        if -float(here[1] @ step) / 2 <= TOLERANCE * min(1.0, here[0]):
            return weights + step, passes
        there, size = at(weights + step), 1.0
        passes += 1
        while not there[0] <= here[0] * (1 + 1e-12) and size > 1e-9:
            size /= 2
            there, passes = at(weights + size * step), passes + 1
        weights, here = weights + size * step, there
        if passes > MAX_PASSES:
            raise RuntimeError(f"no optimum after {passes} passes")


def _on_sample(data: np.ndarray, share: float) -> np.ndarray:
    """The same fit on the driver, over a bounded number of rows."""
    design, y = np.column_stack([data[:, :-1], np.ones(len(data))]), data[:, -1]

    def measure(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        m = design @ w
        p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
        loss = float((np.logaddexp(0, m) - y * m).sum())
        return loss, design.T @ (p - y), (design * (p * (1 - p))[:, None]).T @ design

    return _descend(measure, np.zeros(design.shape[1]), share)[0]


def fit_logistic(rows: DataFrame, names: Sequence[str], label: str, key: str) -> LogisticFit:
    """The optimum over all rows; pass persisted rows with inputs and a 0/1 label as doubles."""
    n = rows.count()
    share = min(1.0, START_ROWS / n)
    start = rows
    if share < 1:
        start = rows.filter(F.pmod(F.xxhash64(key, F.lit("start")), F.lit(1 << 30)) < int(share * (1 << 30)))
    data = np.array([tuple(r) for r in start.select(*names, label).limit(2 * START_ROWS).collect()], float)
    weights = np.zeros(len(names) + 1)
    if len(data) and 0 < data[:, -1].sum() < len(data):
        weights = _on_sample(data, len(data) / n)
    weights, passes = _descend(lambda w: _sums(rows, names, label, w), weights, 1.0)
    return LogisticFit(Vectors.dense(weights[:-1]), float(weights[-1]), passes)
