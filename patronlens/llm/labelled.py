"""A bounded sample of labelled documents, to fit a classifier on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import held_out, stored


def metadata_of(names: Sequence[str]) -> Column:
    """One array of doubles, `metadata`, from numeric columns."""
    return F.array(*[F.col(name).cast("double") for name in names]).cast("array<double>").alias("metadata")


def training_texts(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    limit: int,
    parts: int,
    rest: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata_cols: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, text, label, metadata) of at most `limit` labelled ids, chosen by hash.

    metadata holds the values of `metadata_cols` as doubles.

    Ids held out, null ids and null labels are left out; of conflicting labels the larger
    counts. Only ids and labels are broadcast, `limit` rows at most, so texts are not shuffled.
    """
    own = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    own = own.where(F.col("label_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("label_id"), parts, rest))
    chosen = (
        own.groupBy("label_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(limit)
    )
    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), metadata_of(metadata_cols)
    )
    return stored(
        texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label", "metadata")
    )
