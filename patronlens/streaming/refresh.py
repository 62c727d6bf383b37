"""Refresh the customer features when new transaction files arrive.

Every micro-batch is reduced to partial rows that later batches can be merged with, and is
stored under its batch number. A batch that is repeated after a failure replaces its own
folder, so nothing is counted twice. Partial rows look like transactions: all rows of one
(customer, order, day) are uniform with respect to every window limit, since those limits
are midnights, as long as rows exactly at midnight stay apart. The batch operators therefore
run on the stored state unchanged.
"""

from __future__ import annotations

import json

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from patronlens.functions.dates import midnight
from patronlens.operators.clean import clean_transactions
from patronlens.sources.delimited import drop_missing_tokens

KEYS = ["customer_id", "order_id", "at_midnight", "order_day"]


def partial_rows(transactions: DataFrame) -> DataFrame:
    """Reduce clean transactions to mergeable rows, combined map-side before the shuffle."""
    ts = F.col("order_datetime")
    return transactions.groupBy(
        "customer_id",
        "order_id",
        (ts == midnight(ts)).alias("at_midnight"),
        ts.cast("date").alias("order_day"),
    ).agg(
        F.max(ts).alias("order_datetime"),
        F.sum("total_amount").alias("total_amount"),
        F.count("*").alias("row_count"),
    )


def transaction_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType | str,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """New files of a folder as a stream; streams need their schema stated."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(folder)


def refresh_state(
    transactions: DataFrame,
    state: str,
    after_batch: Callable[[DataFrame, int], None] | None = None,
    date_formats: Sequence[str] = (),
) -> None:
    """Process all files that have arrived since the last run, then stop.

    ``state`` is a folder on storage that all executors share. Progress is kept inside it,
    so files are never read twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        partial_rows(batch).write.mode("overwrite").parquet(f"{state}/rows/batch={number}")
        if after_batch is not None:
            after_batch(stored_rows(batch.sparkSession, state), number)

    query = (
        clean_transactions(drop_missing_tokens(transactions), date_formats)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{state}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _note(spark: SparkSession, state: str) -> tuple[int, str] | None:
    """The last batch covered by a finished compaction, and the schema of partial rows."""
    try:
        done = spark.read.schema("upto bigint, schema string").parquet(f"{state}/compactions")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    row = done.agg(F.max_by(F.struct("upto", "schema"), "upto").alias("last")).head()
    return tuple(row["last"]) if row and row["last"] else None


def stored_rows(spark: SparkSession, state: str) -> DataFrame:
    """All partial rows; use them wherever clean transactions are expected."""
    noted = _note(spark, state)
    if noted is None:
        return spark.read.parquet(f"{state}/rows").drop("batch")
    upto, text = noted
    # The schema is stated, as no batch may be left to take it from.
    schema = StructType.fromJson(json.loads(text))
    with_batch = StructType([*schema.fields]).add("batch", "long")
    rows = spark.read.schema(with_batch).parquet(f"{state}/rows").filter(F.col("batch") > upto)
    merged = spark.read.schema(schema).parquet(f"{state}/compacted/{upto}")
    return merged.unionByName(rows.drop("batch"))


def compact_state(spark: SparkSession, state: str, remove: bool = False) -> None:
    """Merge all stored batches into one table, so that reading does not slow down over time.

    A compaction counts only once its number has been noted, which happens last; one that
    breaks off is simply ignored. ``remove`` deletes the batches it covers afterwards, and the
    tables of compactions before it; no query on the state may be running then.
    """
    noted = _note(spark, state)
    batches = spark.read.schema("batch long").parquet(f"{state}/rows")
    latest = batches.agg(F.max("batch")).head()[0]
    if latest is None or (noted and latest <= noted[0]):
        return
    merged = stored_rows(spark, state).groupBy(*KEYS).agg(
        F.max("order_datetime").alias("order_datetime"),
        F.sum("total_amount").alias("total_amount"),
        F.sum("row_count").alias("row_count"),
    )
    merged.write.mode("overwrite").parquet(f"{state}/compacted/{latest}")
    note = spark.range(1).select(
        F.lit(latest).cast("long").alias("upto"), F.lit(merged.schema.json()).alias("schema")
    )
    note.write.mode("append").parquet(f"{state}/compactions")
    if remove:
        _remove_covered(spark, state, latest)


def _remove_covered(spark: SparkSession, state: str, upto: int) -> None:
    """Delete stored batches up to a number, and older compactions; only folders of this state."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for pattern, first in (("rows/batch=*", 0), ("compacted/*", 1)):
        path = hadoop.Path(f"{state}/{pattern}")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.globStatus(path):
            number = found.getPath().getName().removeprefix("batch=")
            if number.isdigit() and int(number) <= upto - first:
                files.delete(found.getPath(), True)
