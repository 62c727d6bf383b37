"""One-way analysis of variance from mergeable group moments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from patronlens.fixed_values import MIN_GROUP_ROWS, SIGNIFICANCE
from patronlens.functions.fdist import f_p_value
from patronlens.operators.joins import join_unique

DEFAULT_DIMENSIONS = ("device_type",)
# What is tested by default, as {test name: (metric, dimension)}.
DEFAULT_TESTS = {"Avg order value differs by device_type": ("aov", "device_type")}


def average_order_value(transactions: DataFrame) -> DataFrame:
    """Mean amount per customer over all clean transactions, whatever their date.

    Partial rows of the stored stream state count as the transactions they stand for.
    """
    rows = F.sum("row_count") if "row_count" in transactions.columns else F.count("*")
    mean = F.sum("total_amount") / rows
    return transactions.groupBy("customer_id").agg(mean.alias("aov"))


def group_moments(
    rows: DataFrame, tests: Mapping[str, tuple[str, str]] = DEFAULT_TESTS
) -> DataFrame:
    """Rows (test, dimension value, n, mean, variance) for every (metric, dimension) pair.

    All tests share one pass: the input is aggregated map-side before its only shuffle.
    """
    entries = F.array(
        [
            F.struct(
                F.lit(name).alias("test"),
                F.col(dimension).cast("string").alias("group"),
                F.col(metric).cast("double").alias("x"),
            )
            for name, (metric, dimension) in tests.items()
        ]
    )
    return (
        rows.select(F.inline(entries))
        .dropna(subset=["group", "x"])
        .groupBy("test", "group")
        .agg(
            F.count("*").alias("n"),
            F.avg("x").alias("mean"),
            F.var_pop("x").alias("variance"),
        )
    )


def one_way_anova(moments: DataFrame) -> DataFrame:
    """One row per test that has at least two groups of at least five rows each."""
    weighted = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    grand = moments.groupBy("test").agg(weighted.alias("grand"))
    sums = (
        moments.join(grand, "test")
        .groupBy("test")
        .agg(
            F.count("*").alias("k"),
            F.sum("n").alias("rows"),
            F.min("n").alias("smallest"),
            F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("between"),
            F.sum(F.col("n") * F.col("variance")).alias("within"),
        )
        .filter((F.col("k") >= 2) & (F.col("smallest") >= MIN_GROUP_ROWS))
    )
    df_between, df_within = F.col("k") - 1, F.col("rows") - F.col("k")
    ratio = (F.col("between") / df_between) / (F.col("within") / df_within)
    # No spread inside the groups: infinite F if they differ, undefined if they do not.
    f = (
        F.when(F.col("within") > 0, ratio)
        .when(F.col("between") > 0, F.lit(float("inf")))
        .otherwise(F.lit(None).cast("double"))
    )
    return sums.select(
        "test",
        df_between.cast("double").alias("df_between"),
        df_within.cast("double").alias("df_within"),
        f.alias("f"),
    ).withColumn("p", f_p_value("f", "df_between", "df_within"))


def test_records(results: DataFrame) -> DataFrame:
    """The report form of test results: name, method, pValue, result."""
    verdict = F.when(F.col("p") < SIGNIFICANCE, "significant").otherwise("not_significant")
    return results.select(
        F.col("test").alias("name"),
        F.lit("ANOVA").alias("method"),
        F.col("p").alias("pValue"),
        verdict.alias("result"),
    )


test_records.__test__ = False  # not a unit test, whatever its name suggests to a collector


def order_value_test_name(dimension: str) -> str:
    return f"Avg order value differs by {dimension}"


def order_value_tests(customers: DataFrame, *dimensions: str) -> DataFrame:
    """Test records for rows with ``aov`` and the dimensions, by default the device.

    Dimensions that do not exist are passed over. Rows lacking either value, such
    as customers without a master record, take no part.
    """
    present = [d for d in dimensions or DEFAULT_DIMENSIONS if d in customers.columns]
    if not present:
        nothing = customers.sparkSession.range(0)
        return nothing.select(
            F.lit("").alias("name"),
            F.lit("").alias("method"),
            F.lit(0.0).alias("pValue"),
            F.lit("").alias("result"),
        )
    tests = {order_value_test_name(d): ("aov", d) for d in present}
    return test_records(one_way_anova(group_moments(customers, tests)))


def run_tests(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Test records straight from cleaned tables."""
    kept = [c for c in ("device_type",) if c in customers.columns]
    averages = average_order_value(transactions)
    attributes = customers.select("customer_id", *kept)
    return order_value_tests(join_unique(averages, attributes, "customer_id", "inner"))
