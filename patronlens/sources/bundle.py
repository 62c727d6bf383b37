"""The set of input tables an analysis runs on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from patronlens.sources.delimited import drop_missing_tokens, read_delimited


@dataclass(frozen=True)
class TableBundle:
    """Two required tables and three optional ones (None when absent)."""

    customers: DataFrame
    transactions: DataFrame
    payments: DataFrame | None = None
    products: DataFrame | None = None
    inventory: DataFrame | None = None


def read_table(
    spark: SparkSession,
    folder: str,
    name: str,
    fmt: str = "csv",
    sep: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    path = f"{folder.rstrip('/')}/{name}.{fmt}"
    if fmt == "csv":
        return read_delimited(spark, path, sep, multiline)
    return drop_missing_tokens(spark.read.format(fmt).load(path))


def read_optional(
    spark: SparkSession, folder: str, name: str, fmt: str = "csv", **options
) -> DataFrame | None:
    """The table, or None when its path does not exist; other errors are not hidden."""
    try:
        return read_table(spark, folder, name, fmt, **options)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_bundle(spark: SparkSession, folder: str, fmt: str = "csv", **options) -> TableBundle:
    """Load ``customers`` and ``transactions`` (required) and the optional tables.

    ``sep`` and ``multiline`` are passed to the reader of delimited files.
    """
    return TableBundle(
        customers=read_table(spark, folder, "customers", fmt, **options),
        transactions=read_table(spark, folder, "transactions", fmt, **options),
        payments=read_optional(spark, folder, "payments", fmt, **options),
        products=read_optional(spark, folder, "products", fmt, **options),
        inventory=read_optional(spark, folder, "inventory", fmt, **options),
    )
