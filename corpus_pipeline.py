"""From raw documents to packed training sequences, as stages that each read what the last kept.

A stage takes (spark, docs, sf_dir) and returns documents with the same columns, but for the last,
which returns the places of the pieces in the packed sequences. Extra columns stay. Rows with a
null id are judged by their text like all others; they are never linked with another document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.llm import decontaminate, neardup, pack, pii, toxicity
from patronlens.llm.common import fresh, stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; the model learns from the labels of these documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs.columns, "toxicity_score")
    return toxicity.score_documents(docs, model, score_col=score).where(F.col(score) < 0.5).select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; repeated rows leave one.

    Rows that share an id are kept or dropped together. Of those kept, rows with equal sets of shingles
    leave the one that comes first as JSON text; rows with different sets all stay.
    """
    found = neardup.near_duplicates(docs)
    other = fresh(docs.columns, "kept_id")
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(other)).distinct()
    named = docs.join(kept, F.col("doc_id") == F.col(other), "left_semi")
    again = docs.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1")
    again = again.select(F.col("doc_id").alias(other))
    once = named.join(again, F.col("doc_id") == F.col(other), "left_anti")
    row, shown = F.struct(*docs.columns), fresh(docs.columns, "print")
    several = neardup.with_print(named.join(again, F.col("doc_id") == F.col(other), "left_semi"), shown)
    one = several.select("doc_id", F.col(shown).alias("print"), row.alias("row"), F.to_json(row).alias("rank"))
    one = one.groupBy("doc_id", "print").agg(F.min_by("row", "rank").alias("row")).select("row.*")
    return once.unionByName(one).unionByName(docs.where("doc_id IS NULL"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced; n_chars follows the new text."""
    redacted = pii.redact(docs)
    if "n_chars" in redacted.columns:
        kind = redacted.schema["n_chars"].dataType
        redacted = redacted.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return redacted.select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands."""
    return pack.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed_sequences),
]

# The classifiers and the packing have no form in SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
