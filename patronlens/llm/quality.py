"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

The score is a constant, a weight for each feature, and interactions of all pairs of features
through low-rank factors, computed in linear time as half of (sum of factors) squared minus
the sum of squares. Every distinct word of the whole text is hashed to a bucket; statistics of
the text and numeric metadata columns are cut into bins. The machine is fitted on a bounded
sample of `max_labelled` labelled documents by adaptive gradient steps.

Defined results: a null or empty text has no words, and its statistics are zero; it gets the
score that this gives. A metadata value that is null falls into a bin of its own. Without
labels of both kinds the score is the share of good labels (0 without labels). Rows are scored each
for itself, so repeated rows agree. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patronlens.llm.labelled import metadata_of, training_texts

MAX_LABELLED = 12_000
WORD_BUCKETS = 1 << 16
BINS = 12
STATISTICS = 14
RANK = 8
EPOCHS = 6
BATCH = 64
RATE = 0.08
RIDGE = 1e-5
SEED = 17
#: Documents scored at once.
GROUP = 256
SIGNS = re.compile(r"[^\w\s]")


def statistics(text: str, words: list[str]) -> list[float]:
    """Shares in 0..1, and sizes on a logarithmic scale mapped to about 0..1."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    letters = max(1, sum(map(str.isalpha, text)))
    joined = "".join(words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    signs = SIGNS.findall(text)
    return [
        np.log2(len(words) + 1) / 16,
        np.log2(len(text) + 1) / 20,
        len(set(words)) / n,
        repeats / n,
        sum(map(str.isupper, text)) / letters,
        sum(map(str.isdigit, text)) / chars,
        len(signs) / n,
        len(set(signs)) / max(1, len(signs)),
        sum(w[-1] in "*#$%&!|" for w in words) / n,
        sum(len(w) == 1 for w in words) / n,
        min(1.0, len(joined) / n / 16),
        max(map(len, words), default=0) / 64,
        len(set(lines)) / len(lines),
        min(1.0, len(lines) / n * 4),
    ]


def features(text: str | None, metadata: Sequence[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the features of a document."""
    text = text or ""
    words = text.split()
    distinct = {w.lower() for w in words}
    hashed = np.unique(np.fromiter((zlib.crc32(w.encode()) for w in distinct), np.int64, len(distinct)) % WORD_BUCKETS)
    at = [
        WORD_BUCKETS + i * BINS + min(BINS - 1, max(0, int(v * (BINS - 1) + 0.999)))
        for i, v in enumerate(statistics(text, words))
    ]
    first = WORD_BUCKETS + STATISTICS * BINS
    for i, v in enumerate(metadata):
        known = v is not None and np.isfinite(v)
        at.append(first + i * BINS + (1 + min(BINS - 2, int(np.log2(abs(float(v)) + 1) / 2)) if known else 0))
    values = np.concatenate([np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed)))), np.ones(len(at))])
    return np.concatenate([hashed, np.array(at, np.int64)]), values


def n_features(metadata: int) -> int:
    return WORD_BUCKETS + (STATISTICS + metadata) * BINS


@dataclass
class Machine:
    constant: float
    weights: np.ndarray  # (features,)
    factors: np.ndarray  # (features, rank)

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the logistic function; rows begin at `starts` and none is empty."""
        v = self.factors[index] * value[:, None]
        total = np.add.reduceat(v, starts)
        squares = np.add.reduceat(v * v, starts)
        return self.constant + np.add.reduceat(self.weights[index] * value, starts) + 0.5 * (total**2 - squares).sum(1)

    def score(self, texts: Sequence[str | None], metadata: Sequence[Sequence[float | None]]) -> np.ndarray:
        rows = [features(t, m) for t, m in zip(texts, metadata)]
        if not rows:
            return np.empty(0)
        starts = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
        z = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, rank: int = RANK) -> Machine:
    """Adaptive gradient steps over shuffled small batches."""
    rng = np.random.default_rng(SEED)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Machine(30.0 if share else -30.0, np.zeros(size), np.zeros((size, rank)))
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    seen_w, seen_v, seen_c = np.full(size, 1e-3), np.full((size, rank), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for first in range(0, len(rows), BATCH):
            chosen = order[first : first + BATCH]
            lengths = np.array([len(rows[i][0]) for i in chosen])
            starts = np.cumsum(lengths) - lengths
            index = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            z = machine.raw(index, value, starts)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]
            each = np.repeat(error, lengths)
            v = machine.factors[index]
            total = np.repeat(np.add.reduceat(v * value[:, None], starts), lengths, axis=0)
            grad_v = each[:, None] * value[:, None] * (total - v * value[:, None])
            own, place = np.unique(index, return_inverse=True)
            sums = np.zeros((len(own), 1 + rank))
            np.add.at(sums, place, np.column_stack([each * value, grad_v]))
            sums /= len(chosen)
            sums[:, 0] += RIDGE * machine.weights[own]
            sums[:, 1:] += RIDGE * machine.factors[own]
            seen_w[own] += sums[:, 0] ** 2
            seen_v[own] += sums[:, 1:] ** 2
            machine.weights[own] -= RATE * sums[:, 0] / np.sqrt(seen_w[own])
            machine.factors[own] -= 0.5 * RATE * sums[:, 1:] / np.sqrt(seen_v[own])
            seen_c += float(error.mean()) ** 2
            machine.constant -= RATE * float(error.mean()) / np.sqrt(seen_c)
    return machine


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
    parts: int = 4,
    rest: int = 2,
    metadata_cols: Sequence[str] = (),
) -> Machine:
    """The machine, from labels of documents whose crc32 of the id mod parts is not rest."""
    sample = training_texts(docs, labels, label_col, max_labelled, parts, rest, id_col, text_col, metadata_cols)

    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, m) for t, m in zip(batch.column("text").to_pylist(), batch.column("metadata").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("label"),
                 pa.array([i.astype("<u4").tobytes() for i, _ in rows], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())],
                names=["doc_id", "label", "index", "value"],
            )

    found = sample.mapInArrow(to_features, "doc_id string, label int, index binary, value binary").toPandas()
    found = found.sort_values(["doc_id", "index"], kind="stable")
    rows = [
        (np.frombuffer(i, "<u4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64))
        for i, v in zip(found["index"], found["value"])
    ]
    return fit(rows, (found["label"].to_numpy() > 0).astype(np.float64), n_features(len(metadata_cols)))


def score_documents(
    docs: DataFrame,
    machine: Machine,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata_cols: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, score. metadata_cols are those of the training, in the same order."""
    if len(machine.weights) != n_features(len(metadata_cols)):
        raise ValueError(f"the machine was not fitted with {len(metadata_cols)} metadata columns")
    schema = StructType().add("doc_id", docs.schema[id_col].dataType).add("score", "double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, metadata = batch.column("text").to_pylist(), batch.column("metadata").to_pylist()
            scores = [
                machine.score(texts[i : i + GROUP], metadata[i : i + GROUP]) for i in range(0, len(texts), GROUP)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate([*scores, np.empty(0)]))], names=schema.names
            )

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), metadata_of(metadata_cols))
    return texts.mapInArrow(judge, schema)
