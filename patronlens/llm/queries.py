"""The registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.llm import decontaminate, divergence, language, lines, neardup, pack, pii, quality, rans, toxicity, trie, urls, vectors
from patronlens.llm.common import held_out, table
from patronlens.sources.sinks import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_vector_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op2_text_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), words=2)


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    machine = quality.train(docs, table(spark, folder, "labels"), metadata_cols=["n_chars"])
    return quality.score_documents(docs, machine, metadata_cols=["n_chars"]).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack.pack(table(spark, folder, "documents"))


def op7_rans_files(spark: SparkSession, folder: str) -> DataFrame:
    files = shared_folder(spark)
    rans.write_ids(table(spark, folder, "documents"), files)
    return rans.read_ids(spark, files)


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.report(table(spark, folder, "documents")).drop("text_hash")
    return found.withColumnRenamed("id", "doc_id")


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    return language.predict(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score"
    )


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    index = lines.insert(lines.empty_index(spark), docs)
    return lines.drop_repeated_lines(docs, index, known=True).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = trie.turns(table(spark, folder, "conversations"))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return trie.prefix_trie(turns, trie.with_base_prefix(turns, 20, taken, 3)).drop("name")


QUERIES: dict[str, Query] = {
    "op1_vector_duplicates": op1_vector_duplicates,
    "op2_text_duplicates": op2_text_duplicates,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_pack": op6_pack,
    "op7_rans_files": op7_rans_files,
    "op8_pii": op8_pii,
    "op9_language": op9_language,
    "op10_url_filter": op10_url_filter,
    "op11_source_divergence": op11_source_divergence,
    "op12_line_dedup": op12_line_dedup,
    "op13_conversation_trie": op13_conversation_trie,
}
