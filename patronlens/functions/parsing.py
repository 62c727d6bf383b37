"""Coercions that turn dirty text into typed values, or null, without ever failing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, NumericType, StringType

from patronlens.fixed_values import MISSING_TOKENS

NUMBER_SHAPE = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?)?$"
PLAIN_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def missing_to_null(value: Column, dtype: DataType) -> Column:
    """Map missing-value tokens (text) and NaN (floats) to null."""
    if isinstance(dtype, StringType):
        return F.when(~value.isin(MISSING_TOKENS), value)
    if isinstance(dtype, (DoubleType, FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def parse_number(value: Column, dtype: DataType) -> Column:
    """Double, or null for text that is not entirely a number.

    The shape test is needed because a bare cast accepts suffixes ('5d') and the word NaN.
    """
    if isinstance(dtype, (DoubleType, FloatType)):
        return missing_to_null(value, dtype).cast("double")
    if isinstance(dtype, NumericType):
        return value.cast("double")
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def parse_timestamp(
    value: Column, dtype: DataType, formats: Sequence[str] = ()
) -> Column:
    """Zone-less timestamp, or null for text that is not a date.

    ISO text always parses, the compact form of a day (20240115) and an hour alone included. A
    zone is dropped and the clock time kept. Other layouts are tried in the order the caller lists them.
    Ordinary values meet one test of their shape; rarer forms are worked out only where it fails.
    """
    if not isinstance(dtype, StringType):
        return value.cast("timestamp_ntz")
    text = F.trim(value)
    clock = F.when(F.length(text) > 10, F.regexp_replace(text, ZONE, "")).otherwise(text)
    clock = F.regexp_replace(clock, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    clock = F.regexp_replace(clock, r"^(\S{10}[ T]\d{2})$", "$1:00")
    iso = F.when(clock.rlike(DATE_SHAPE), clock.try_cast("timestamp_ntz"))
    extra = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    plain = text.rlike(PLAIN_DATE)
    return F.when(plain, text.try_cast("timestamp_ntz")).otherwise(F.coalesce(iso, *extra))


def parse_flag(value: Column) -> Column:
    """True only for the word TRUE in any case; everything else, null included, is false."""
    return F.coalesce(F.upper(value.cast("string")) == "TRUE", F.lit(False))
