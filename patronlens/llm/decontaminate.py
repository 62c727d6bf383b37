"""Benchmark decontamination: a broadcast table of normalised test n-grams.

Every window of `window` words of a document is hashed and looked up among the windows of the
benchmark items; a hash that is found is verified word by word. The table of windows is
broadcast only if its measured size is below `max_broadcast_bytes`; beyond that the windows
meet in a shuffled join, with the same result.

Defined results: a null or empty text, or one without words, has no words and no hits. An item
without words matches nothing; items of fewer than `window` words are one window of their own
length. Items with the same text, and repeated items, all count by their id (a null id is
left out of the list). Rows of documents that agree in id and text give one result row each.
An empty benchmark hits nothing. Other columns of either table play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import fresh, lower_ascii, stored

# Words are runs of digits, letters and any character beyond ASCII; what lies between is cut
# away, which Spark does far faster than extracting the words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
MAX_BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    parts = F.split(F.coalesce(lower_ascii(text), F.lit("")), BETWEEN_WORDS, -1)
    return F.array_remove(parts, "")


def _gram(words: str, start: Column, length: int) -> Column:
    """Hash of `length` words from `start`, counted from 0."""
    return F.xxhash64(*[F.get(F.col(words), start + k) for k in range(length)])


def benchmark_windows(
    benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """(gram, gram_words, length, items): each distinct window and the ids that contain it."""
    words = benchmark.select(
        F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")
    ).where("size(words) > 0")
    starts = f"sequence(1, greatest(1, size(words) - {window - 1}))"
    runs = words.select("item", F.expr(f"explode(transform({starts}, i -> slice(words, i, {window})))")
                        .alias("gram_words"))
    return (
        runs.groupBy("gram_words")
        .agg(F.collect_set("item").alias("items"))
        .select(
            _gram("gram_words", F.lit(0), window).alias("gram"),  # nulls don't count
            "gram_words",
            F.size("gram_words").alias("length"),
            "items",
        )
    )


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """One row per document row: id, text_hash, n_words, n_hit, item_ids and hits.

    hits is the sorted array of (start, length) word windows that occur in an item.
    """
    grams = stored(benchmark_windows(benchmark, item_col, item_text_col, window))
    size = grams.agg(
        F.sum(F.length(F.concat_ws(" ", "gram_words")) + 24 * F.size("items") + 200).alias("b"),
        F.collect_set("length").alias("lengths"),
    ).first()
    lengths = sorted(size["lengths"], reverse=True)  # at most `window` values
    base = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        words_of(F.col(text_col)).alias("words"),
    ).select("*", F.size("words").alias("n"))

    # Each row is repeated: once for itself, then once for each window of each length. `at`
    # counts these, and start and length of the window follow from it. All of this, and the
    # lookup, stays in generated code.
    start, length, hash_, before = F.lit(-1), F.lit(0), F.lit(None).cast("long"), F.lit(1)
    for k in lengths:
        count = F.greatest(F.lit(0), F.col("n") - k + 1)
        here = (F.col("at") >= before) & (F.col("at") < before + count)
        start = F.when(here, F.col("at") - before).otherwise(start)
        length = F.when(here, F.lit(k)).otherwise(length)
        hash_ = F.when(here, _gram("words", F.col("at") - before, k)).otherwise(hash_)
        before = before + count
    # The outer form, as the plain one would let the optimiser copy the expressions below it
    # into a filter.
    exploded = base.select(
        "id", "text_hash", "n", "words", F.explode_outer(F.sequence(F.lit(0), before - 1)).alias("at")
    ).withColumn("hash", hash_)
    hit = F.struct(start.alias("start"), length.alias("length"))
    run = F.slice(F.col("words"), F.greatest(start + 1, F.lit(1)), length)

    if (size["b"] or 0) <= max_broadcast_bytes:
        table = F.broadcast(grams.select("gram", "gram_words", "items"))
        found = (
            exploded.join(table, F.col("hash") == F.col("gram"), "left")
            .where((F.col("at") == 0) | (run == F.col("gram_words")))
            .select("id", "text_hash", "n", "at", hit.alias("hit"), "items")
        )
    else:
        found = _shuffled_hits(base, exploded, grams, hit, run)

    grouped = found.groupBy("id", "text_hash").agg(
        F.max("n").cast("long").alias("n_words"),
        F.sum((F.col("at") == 0).cast("int")).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at") > 0, F.col("hit")))).alias("hits"),
        F.array_sort(
            F.array_distinct(F.flatten(F.collect_set(F.when(F.col("at") > 0, F.col("items")))))
        ).alias("item_ids"),
    )
    covered = F.expr(
        "aggregate(hits, named_struct('end', 0, 'n', 0L), (a, h) -> named_struct("
        "'end', greatest(a.end, h.start + h.length),"
        "'n', a.n + greatest(0, h.start + h.length - greatest(a.end, h.start))), a -> a.n)"
    )
    return grouped.select(
        "id", "text_hash", "n_words", covered.alias("n_hit"), "item_ids", "hits",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def _shuffled_hits(
    base: DataFrame, exploded: DataFrame, grams: DataFrame, hit: Column, run: Column
) -> DataFrame:
    """The hits by a shuffled join on the hash, then verified against the words of the row."""
    keys = ["id", "text_hash", "n", "at"]
    rows = exploded.select(*keys, "hash")
    own = rows.where("at = 0").select(*keys, hit.alias("hit"), F.lit(None).cast("array<string>").alias("items"))
    candidates = rows.where("at > 0").distinct().join(grams, F.col("hash") == F.col("gram")).drop("length")
    texts = base.select(
        F.col("id").alias("id_"), F.col("text_hash").alias("hash_"), "words"
    ).dropDuplicates(["id_", "hash_"])
    verified = candidates.join(
        texts, F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_"))
    ).where(run == F.col("gram_words"))
    return own.unionByName(verified.select(*keys, hit.alias("hit"), "items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    found = find_hits(docs, benchmark, id_col, text_col, **options).where("n_hit > 0")
    return _join_back(docs, found, id_col, text_col, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", **options) -> DataFrame:
    """All documents; words inside benchmark windows are cut out, and each with the
    characters up to the next word."""
    found = find_hits(docs, benchmark, id_col, text_col, **options).where("n_hit > 0")
    found = found.select("id", "text_hash", "hits").dropDuplicates(["id", "text_hash"])
    text = F.col(text_col)
    gaps, raw = fresh(docs.columns, "gaps"), fresh(docs.columns, "raw_words")
    joined = _join_back(docs, found, id_col, text_col, "left")
    hits = joined.columns[-1]
    parts = joined.withColumn(gaps, F.split(text, RAW_WORD, -1)).withColumn(
        raw, F.array_remove(F.split(text, RAW_BETWEEN, -1), "")
    )
    inside = f"exists(`{hits}`, h -> i >= h.start AND i < h.start + h.length)"
    kept = F.expr(
        f"concat(element_at(`{gaps}`, 1), array_join(transform(`{raw}`, (w, i) ->"
        f" IF({inside}, '', concat(w, element_at(`{gaps}`, i + 2)))), ''))"
    )
    return parts.withColumn(text_col, F.when(F.col(hits).isNull(), text).otherwise(kept)).select(docs.columns)


def _join_back(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """docs joined with results on id and text; the result columns get free names."""
    names = {c: fresh(docs.columns, f"found_{c}") for c in ("id", "text_hash", "hits")}
    other = found.select([F.col(c).alias(new) for c, new in names.items()])
    return docs.join(
        other,
        docs[id_col].eqNullSafe(other[names["id"]])
        & (F.xxhash64(docs[text_col]) == other[names["text_hash"]]),
        how,
    )
