"""Cleaning: coerce types, drop unusable rows. Projections and filters only, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from pyspark.sql.types import IntegralType, NumericType

from patronlens.fixed_values import (
    CUSTOMER_NUMBERS,
    TRANSACTION_NUMBERS,
    TRANSACTION_REQUIRED,
)
from patronlens.functions.parsing import parse_flag, parse_number, parse_timestamp
from patronlens.sources.bundle import TableBundle


def _coerced(
    df: DataFrame, dates: Sequence[str], numbers: Sequence[str], formats: Sequence[str]
) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema}
    new = {c: parse_timestamp(F.col(c), types[c], formats) for c in dates}
    new |= {c: parse_number(F.col(c), types[c]) for c in numbers if c in types}
    return df.withColumns(new)


def _present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without nulls; one plain test per column, since only those reach the scan."""
    return df.filter(reduce(and_, [F.col(c).isNotNull() for c in columns]))


def clean_customers(customers: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    given = _present(customers, ["customer_id"])
    typed = _coerced(given, ["account_creation_date"], CUSTOMER_NUMBERS, date_formats)
    return _present(typed, ["customer_id"])


def clean_transactions(
    transactions: DataFrame, date_formats: Sequence[str] = ()
) -> DataFrame:
    """Typed transactions without rows that lack an id, a valid date or a valid amount.

    The test on the raw columns is implied by the one on the typed columns; it is made
    separately because tests on computed columns are not pushed down.
    """
    given = _present(transactions, TRANSACTION_REQUIRED)
    typed = _coerced(given, ["order_datetime"], TRANSACTION_NUMBERS, date_formats)
    kept = _present(typed, TRANSACTION_REQUIRED)
    if "coupon_applied" in kept.columns:
        kept = kept.withColumn("coupon_applied", parse_flag(F.col("coupon_applied")))
    return kept


def clean_bundle(
    bundle: TableBundle, date_formats: Sequence[str] = (), customer_formats: Sequence[str] | None = None
) -> TableBundle:
    """Clean customers and transactions; the other tables pass through unchanged.

    ``date_formats`` holds for both tables unless ``customer_formats`` is given. Customer ids keep
    their type, since numbers are smaller to shuffle than text. Two types of numbers become doubles, or
    longs if both are whole numbers, so that equal ids stay equal (longs beside doubles do up to
    2^53). If only one side is text, both become text: a mixed join would coerce values silently.
    """
    customers = clean_customers(bundle.customers, date_formats if customer_formats is None else customer_formats)
    transactions = clean_transactions(bundle.transactions, date_formats)
    key = "customer_id"
    types = [customers.schema[key].dataType, transactions.schema[key].dataType]
    if types[0] != types[1]:
        common = "string"
        if all(isinstance(t, NumericType) for t in types):
            common = "bigint" if all(isinstance(t, IntegralType) for t in types) else "double"
        customers = customers.withColumn(key, F.col(key).cast(common))
        transactions = transactions.withColumn(key, F.col(key).cast(common))
    return replace(bundle, customers=customers, transactions=transactions)
