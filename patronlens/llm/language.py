"""Language identification: known words first, then shorter and shorter character n-grams.

Words of the training documents get a log frequency for each language. A word that is not
known is scored by its longest character n-grams of which one is known. The languages'
scores add up over the words of the whole text; a tempered softmax gives the score.

The sample to learn from is bounded: about `per_language` documents of each language, chosen by
hash of the id. Each language brings its most frequent words and n-grams, an equal share of `max_words`
and `max_grams` but never under LEAST_EACH. Over MAX_LANGUAGES languages are an error.

Defined results: `und` with score 0 for a null text and one without letters, and if nothing
could be learned. Documents with null lang teach nothing. Ties go to the language that comes
first in order. Rows are judged each for itself, so repeated rows agree. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patronlens.llm.common import held_out, stored

PER_LANGUAGE = 3_000
#: More are an error, as the table of scores has a column for each.
MAX_LANGUAGES = 500
#: Words, and n-grams, of each language at least, if it has them.
LEAST_EACH = 500
MAX_WORDS = 60_000
MAX_GRAMS = 60_000
LONGEST = 5
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Words that a worker keeps with their scores.
CACHE = 400_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]


@dataclass
class Model:
    languages: list[str]
    index: dict[str, int]  # word, or n-gram after its length: row of scores
    scores: np.ndarray  # (rows, languages): log frequencies
    floor: np.ndarray  # score of what no language knows
    _cache: dict = field(default_factory=dict, repr=False, compare=False)
    _rows: np.ndarray | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_cache": {}, "_rows": None}

    def word_score(self, word: str) -> np.ndarray:
        row = self.index.get(word)
        if row is not None:
            return self.scores[row]
        for n in range(LONGEST, 0, -1):
            rows = [r for g in grams_of(word, n) if (r := self.index.get(f"{n}:{g}")) is not None]
            if rows:
                return self.scores[rows].mean(0)
        return self.floor

    def judge(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not self.languages or not any(map(str.isalpha, words)):
            return UNKNOWN, 0.0
        cache = self._cache
        try:
            rows = [cache[w] for w in words]
        except KeyError:
            new = {w for w in words if w not in cache}
            if self._rows is None or len(cache) + len(new) > CACHE:
                cache.clear()
                new = set(words)
                self._rows = np.empty((0, len(self.languages)), np.float32)
            first = len(cache)
            if first + len(new) > len(self._rows):
                more = max(len(new), len(self._rows), 1024)
                self._rows = np.concatenate([self._rows, np.empty((more, len(self.languages)), np.float32)])
            for i, w in enumerate(sorted(new), first):
                cache[w] = i
                self._rows[i] = self.word_score(w)
            rows = [cache[w] for w in words]
        total = self._rows[rows].sum(0, dtype=np.float64)
        best = int(total.argmax())
        # Words of a text depend on each other: their evidence counts as that of fewer words.
        tempered = (total - total[best]) / np.sqrt(len(words))
        return self.languages[best], float(1 / np.exp(tempered).sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n) of words and n-grams: partial counts, given out before they grow large."""
    words: defaultdict[str, Counter[str]] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        langs, keys, numbers = [], [], []
        for lang, own in words.items():
            counts = Counter(own)
            for word, n in own.items():  # each distinct word is taken apart once
                for size in range(1, LONGEST + 1):
                    for gram in grams_of(word, size):
                        counts[f"{size}:{gram}"] += n
            langs += [lang] * len(counts)
            keys += counts.keys()
            numbers += counts.values()
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(numbers, pa.int64())],
            names=["lang", "key", "n"],
        )

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words[lang].update(words_of(text))
            if sum(map(len, words.values())) > 60_000:
                yield out()
                words.clear()
    yield out()


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    parts: int = 4,
    rest: int = 2,
    per_language: int = PER_LANGUAGE,
    max_words: int = MAX_WORDS,
    max_grams: int = MAX_GRAMS,
) -> Model:
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), parts, rest))
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"))
    rates = stored(sizes.select(F.col("lang").alias("of"), (F.lit(float(per_language)) / F.col("n")).alias("rate")))
    if (n_languages := rates.count()) > MAX_LANGUAGES:
        raise ValueError(f"{n_languages} languages; the model has room for {MAX_LANGUAGES}")
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = own.join(F.broadcast(rates), F.col("lang") == F.col("of")).where(share < F.col("rate"))
    counted = stored(
        sample.select("lang", "text").mapInArrow(_count, "lang string, key string, n long")
        .groupBy("lang", "key").agg(F.sum("n").alias("n"))
    )
    gram = F.col("key").contains(":")
    totals = counted.groupBy(
        "lang", F.when(gram, F.substring("key", 1, 1)).otherwise("0").alias("level")
    ).agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in totals})
    if not languages:
        return Model([], {}, np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    of = {lang: i for i, lang in enumerate(languages)}
    by_key = counted.groupBy("key").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("lang", F.col("n").alias("c"))).alias("langs")
    )
    rank = F.row_number().over(Window.partitionBy("lang", gram).orderBy(F.desc("n"), "key"))
    each = [max(most // len(languages), LEAST_EACH) for most in (max_words, max_grams)]
    ranked = counted.withColumn("rank", rank).where(F.col("rank") <= F.when(gram, each[1]).otherwise(each[0]))
    top = [
        by_key.join(ranked.select("key").distinct(), "key", "left_semi").where(condition).orderBy(F.desc("n"), "key")
        for condition in (~gram, gram)
    ]
    size = {(r["lang"], r["level"]): r["n"] for r in totals}
    levels = [str(n) for n in range(LONGEST + 1)]
    total = np.array([[size.get((lang, level), 0) for lang in languages] for level in levels], np.float64)
    index: dict[str, int] = {}
    rows = []
    for frame in top:
        for key, _, langs in frame.toPandas().itertuples(index=False):
            level = int(key[0]) if ":" in key else 0
            counts = np.full(len(languages), 0.5)
            for entry in langs:
                counts[of[entry["lang"]]] += entry["c"]
            index[key] = len(rows)
            rows.append(np.log(counts / (total[level] + 1_000)))
    scores = np.array(rows, np.float32).reshape(-1, len(languages))
    floor = np.log(0.5 / (total[1] + 1_000)).astype(np.float32)
    return Model(languages, index, scores, floor)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    schema = StructType().add("doc_id", docs.schema[id_col].dataType).add("lang_pred", "string").add("score", "double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.judge(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=schema.names,
            )

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(judge, schema)
