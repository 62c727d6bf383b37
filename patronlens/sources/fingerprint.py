"""Which files a table was read from, told by their listing alone."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F


def fingerprint(*tables: DataFrame | None) -> str | None:
    """A text that changes when a file is added, removed, resized or written anew; None if a
    table does not come from files, or not from files alone.

    Path, length and time of the files are listed; no contents are read.
    """
    paths: set[str] = set()
    spark: SparkSession | None = None
    for table in tables:
        if table is not None:
            spark = table.sparkSession
            found = [unquote(path) for path in table.inputFiles()]
            if not found or not _only_files(table):
                return None
            paths.update(found)
    if spark is None:
        return None
    files = spark.read.format("binaryFile").load(sorted(paths)).select("path", "length", "modificationTime")
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    row = files.agg(F.count("*"), F.sum("length"), F.bit_xor(one), F.bit_xor(F.xxhash64(one, F.lit(1)))).head()
    return "-".join(str(value) for value in row)


def _only_files(table: DataFrame) -> bool:
    """Whether every leaf of the table's plan reads files."""
    leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
    names = [leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())]
    return all(name == "LogicalRelation" for name in names)
