"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.sources.sinks import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: it cuts the lineage, and
    the rows outlive the executors that made them."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(names: Iterable[str], wish: str) -> str:
    """A column name like `wish` that no column has, compared without case as Spark does."""
    taken = {name.lower() for name in names}
    while wish.lower() in taken:
        wish += "_"
    return wish


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))
