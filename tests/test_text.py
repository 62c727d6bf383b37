import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from patronlens.functions.numbers import clamp01, relative_change
from patronlens.functions.text import fixed_text, grouped_whole, percent_text
from patronlens.operators import display

VALUES = [0.0, 0.05, 0.1, 0.15, 0.25, 0.35, 0.45, 0.5, 1.5, 2.5, 12.5, 12.35, 99.95, 99.949,
          0.00005, 0.00015, 0.0124999, 1234567.875, -0.25, -1.5, 1e9 + 0.5]
VALUES += [random.Random(7).uniform(0, 100) for _ in range(300)]
VALUES += [i / 40 for i in range(200)]


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_fixed_text_equals_c_style_formatting(spark, digits):
    frame = spark.createDataFrame([(v,) for v in VALUES], "v double")
    for row in frame.select("v", fixed_text(F.col("v"), digits).alias("t")).collect():
        assert float(row["t"]) == float(f"{row['v']:.{digits}f}"), row["v"]
        assert row["t"].lstrip("-") == f"{abs(row['v']):.{digits}f}"


def test_ties_up(spark):
    frame = spark.createDataFrame([(abs(v),) for v in VALUES], "v double")
    for row in frame.select("v", fixed_text(F.col("v"), 1, "up").alias("t")).collect():
        exact = Decimal(row["v"]).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)
        assert Decimal(row["t"]) == exact


def test_percent_text(spark):
    frame = spark.createDataFrame([(a / b,) for b in (3, 7, 8, 40, 1000) for a in range(b)], "v double")
    for row in frame.select("v", percent_text(F.col("v"), 1).alias("t")).collect():
        assert row["t"] + "%" == f"{row['v']:.1%}"


def one(spark, column, value, dtype="double"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(column(F.col("v"))).head()[0]


@pytest.mark.parametrize(
    ("value", "text"),
    [(1234.5, "1,235"), (1234.4999, "1,234"), (0.49999999999999994, "0"), (2.5, "3"),
     (6207673.94, "6,207,674"), (-2.5, "-2")],
)
def test_grouped_whole(spark, value, text):
    assert one(spark, grouped_whole, value) == text


@pytest.mark.parametrize(
    ("value", "expected"),
    [(0.5, 0.5), (-3.0, 0.0), (7.0, 1.0), (math.nan, 0.0), (math.inf, 0.0), (-math.inf, 0.0), (None, 0.0)],
)
def test_clamp(spark, value, expected):
    assert one(spark, clamp01, value) == expected


@pytest.mark.parametrize(
    ("delta", "direction", "text"),
    [(0.1234, "up", "+12.3%"), (-0.05, "down", "-5.0%"), (0.0, "none", "0.0%"),
     (None, "none", ""), (math.nan, "none", ""), (0.00125, "up", "+0.1%"), (0.0225, "up", "+2.3%")],
)
def test_delta(spark, delta, direction, text):
    assert one(spark, display.delta_direction, delta) == direction
    assert one(spark, display.delta_text, delta) == text


@pytest.mark.parametrize(
    ("risk", "band"), [(0.71, "high"), (0.7, "medium"), (0.3, "low"), (0.31, "medium"), (0.0, "low")]
)
def test_churn_band_limits_are_strict(spark, risk, band):
    assert one(spark, display.churn_band, risk) == band


def test_segment_label(spark):
    assert one(spark, display.segment_label, "Top Buyer", "string") == "Top Buyers"
    assert one(spark, display.segment_label, "At-Risk", "string") == "At-Risk"


def test_relative_change_without_base(spark):
    frame = spark.sql("SELECT 3D AS a, 0D AS z, 2D AS b")
    row = frame.select(
        relative_change(F.col("a"), F.col("b")), relative_change(F.col("a"), F.col("z"))
    ).head()
    assert tuple(row) == (0.5, None)
