"""Where results go: report files, result tables and scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared directory the cluster names in its settings.

    A machine-local folder is used only where the setting is missing and Spark itself runs
    on this one machine, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/patronlens-{uuid.uuid4().hex}"


def write_result(
    df: DataFrame, path: str, days: int, anchor: str, fmt: str = "parquet"
) -> None:
    """Store a result under (days, anchor); a repeated run replaces only its own partition."""
    (
        df.withColumn("days", F.lit(int(days)))
        .withColumn("anchor", F.lit(anchor).cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("days", "anchor")
        .format(fmt)
        .save(path)
    )


def write_csv_report(sections: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Write each section as CSV with a header; nested columns are stored as JSON text."""
    paths = {}
    for name, df in sections.items():
        flat = df.select(
            [
                F.to_json(f.name).alias(f.name)
                if isinstance(f.dataType, (ArrayType, MapType, StructType))
                else F.col(f.name)
                for f in df.schema
            ]
        )
        paths[name] = f"{folder.rstrip('/')}/{name}"
        flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(
            paths[name]
        )
    return paths
