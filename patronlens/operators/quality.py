"""Data profile, cleaning report and retention of old rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from patronlens.functions.parsing import parse_number, parse_timestamp
from patronlens.fixed_values import TRANSACTION_REQUIRED

# Retention policies in months; None keeps everything.
RETENTION_MONTHS = {
    "3 Months": 3, "6 Months": 6, "1 Year": 12, "2 Years": 24, "Forever": None,
}


def profile(df: DataFrame, key: str, ts: str | None = None) -> DataFrame:
    """One row: rows, columns, first and last date, distinct keys.

    Rows are counted per key first, so the distinct count needs no second pass and no task
    receives more than one partial row per key and task.
    """
    when = F.col(ts) if ts else F.lit(None)
    per_key = df.groupBy(F.col(key).alias("_key")).agg(
        F.count("*").alias("n"),
        F.min(when.cast("date")).alias("first"),
        F.max(when.cast("date")).alias("last"),
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.count("_key").alias("distinct_keys"),
    )


SHOWN = 64  # characters of the least and greatest text


def _bounds(column: str, dtype: DataType) -> tuple[Column, Column]:
    """(value as text, value as number) that least and greatest are taken of; null where neither fits."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    if isinstance(dtype, (NumericType, BooleanType)):
        number = F.col(column).cast("double")
    elif isinstance(dtype, StringType):
        text = F.left(F.col(column), F.lit(SHOWN))
    elif isinstance(dtype, (DateType, TimestampType, TimestampNTZType)):
        text = F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss")
    return text, number


def column_parts(df: DataFrame) -> DataFrame:
    """A mergeable profile row for each column, from one aggregate over the table that its schema
    gives: rows, nulls, a sketch of the distinct values, and bounds."""
    sums = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema):
        text, number = _bounds(f"`{f.name}`", f.dataType)
        given = F.col(f"`{f.name}`").isNotNull()
        sums += [
            F.count_if(~given).alias(f"nulls{i}"),
            F.hll_sketch_agg(F.when(given, F.xxhash64(f"`{f.name}`"))).alias(f"sketch{i}"),
            F.min(text).alias(f"lt{i}"), F.max(text).alias(f"gt{i}"),
            F.min(number).alias(f"ln{i}"), F.max(number).alias(f"gn{i}"),
        ]
    each = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            F.col("rows"), F.col(f"nulls{i}").alias("nulls"), F.col(f"sketch{i}").alias("sketch"),
            F.col(f"lt{i}").alias("least_text"), F.col(f"gt{i}").alias("greatest_text"),
            F.col(f"ln{i}").alias("least_number"), F.col(f"gn{i}").alias("greatest_number"),
        )
        for i, f in enumerate(df.schema)
    ]
    return df.agg(*sums).select(F.inline(F.array(*each)))


def merged_parts(parts: DataFrame) -> DataFrame:
    """One row for each column, from the parts of several pieces of a table, such as its days."""
    return parts.groupBy("position", "column", "type").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("sketch").alias("sketch"),
        F.min("least_text").alias("least_text"), F.max("greatest_text").alias("greatest_text"),
        F.min("least_number").alias("least_number"), F.max("greatest_number").alias("greatest_number"),
    )


def column_profile(df: DataFrame, key: str | None = None) -> DataFrame:
    """A row for each column; distinct values are estimated, those of ``key`` also counted exactly."""
    parts = column_parts(df)
    exact = profile(df, key).select("distinct_keys").scalar() if key else F.lit(None)
    shown = parts.select(
        *[c for c in parts.columns if c != "sketch"], F.hll_sketch_estimate("sketch").alias("distinct_estimate")
    )
    return shown.withColumn("distinct_keys", F.when(F.col("column") == F.lit(key), exact).cast("bigint"))


def sample_rows(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first n rows by a column, so that the preview is the same on every run."""
    return df.orderBy(order).limit(n)


def usable_transaction(df: DataFrame, date_formats: Sequence[str] = ()) -> Column:
    """True for rows that cleaning keeps."""
    types = {f.name: f.dataType for f in df.schema}
    keep = F.lit(True)
    for c in TRANSACTION_REQUIRED:
        value = F.col(c)
        if c == "order_datetime":
            value = parse_timestamp(value, types[c], date_formats)
        elif c == "total_amount":
            value = parse_number(value, types[c])
        keep = keep & value.isNotNull()
    return keep


def cleaning_report(transactions: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    """One row: rows, rows retained, their share, and exact duplicates among them.

    Equal rows collapse map-side before the shuffle, so a row repeated very often costs no
    more than any other. What moves is a row's 128-bit hash, not the row.
    """
    values = [v for c in transactions.columns for v in (F.isnull(c), F.col(c))]  # hashing skips nulls
    marked = transactions.select(
        F.xxhash64(*values).alias("_a"), F.xxhash64(F.lit(1), *values).alias("_b"),
        usable_transaction(transactions, date_formats).alias("_usable"),
    )
    copies = marked.groupBy(*marked.columns).agg(F.count("*").alias("_copies"))
    kept = F.when(F.col("_usable"), F.col("_copies")).otherwise(0)
    removed = F.when(F.col("_usable"), F.col("_copies") - 1).otherwise(0)
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_total"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("rows_retained"),
        F.coalesce(F.sum(removed), F.lit(0)).alias("duplicates"),
    ).withColumn(
        "retained_share",
        F.try_divide(F.col("rows_retained").cast("double"), F.col("rows_total")),
    )


def retention_start(anchor: datetime, months: int | None) -> Column | None:
    if months is None:
        return None
    day = F.add_months(F.lit(anchor.date().isoformat()).cast("date"), -months)
    return day.cast("timestamp_ntz")


def apply_retention(
    df: DataFrame, anchor: datetime, months: int | None, ts: str = "order_datetime"
) -> DataFrame:
    """Keep rows not older than the given months before the anchor; a pushed-down filter."""
    start = retention_start(anchor, months)
    return df if start is None else df.filter(F.col(ts) >= start)


def retention_summary(
    df: DataFrame, anchor: datetime, ts: str = "order_datetime", amount: str = "total_amount"
) -> DataFrame:
    """Rows (policy, rows, amount) kept under every policy, from a single pass."""
    rows = []
    aggregates = []
    for i, (policy, months) in enumerate(RETENTION_MONTHS.items()):
        start = retention_start(anchor, months)
        keep = F.lit(True) if start is None else F.col(ts) >= start
        aggregates += [
            F.count_if(keep).alias(f"n{i}"),
            F.sum(F.when(keep, F.col(amount))).alias(f"a{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(policy).alias("policy"),
                F.col(f"n{i}").alias("kept_rows"),
                F.col(f"a{i}").alias("kept_amount"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(rows)))
