"""Delimited text files whose separator is not known in advance."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from patronlens.fixed_values import SEPARATORS
from patronlens.functions.parsing import missing_to_null


def pick_separator(header: str) -> str:
    """The candidate that occurs most often outside quotes; comma when there is none."""
    bare = re.sub(r'"[^"]*"', "", header)
    return max(SEPARATORS, key=bare.count)


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, multiline: bool = False
) -> DataFrame:
    """Read a delimited file or folder with a header row; every column stays text.

    Only the header line is looked at up front. Types are never inferred, which would cost
    a second scan and could differ between files; the cleaning step coerces instead. Files
    stay splittable unless ``multiline`` says that quoted fields may hold line breaks.
    """
    first = spark.read.text(path).head()
    header = first[0].lstrip("﻿") if first else ""
    sep = sep or pick_separator(header)
    names = next(csv.reader([header], delimiter=sep), [])
    schema = StructType([StructField(n, StringType()) for n in names])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        # A file of the folder whose header differs is an error: its columns would be mixed up.
        .option("enforceSchema", False)
        .csv(path)
    )
    return drop_missing_tokens(rows)


def drop_missing_tokens(df: DataFrame) -> DataFrame:
    """Turn missing-value tokens in text columns and NaN in float columns into null."""
    return df.select(
        [missing_to_null(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    )
