"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: compatibility forms, look-alike letters of other scripts, invisible
characters, and digits or signs that stand in for letters. The lexicon holds whole words and
beginnings of words with their log odds, learned from labelled documents (a bounded sample of
`max_labelled`); one pass of the automaton finds all of them. Of overlapping entries the
heaviest counts; a hit inside an exception phrase does not. The sum, the sum relative to the
number of words, and the heaviest entry give the score by a logistic model, fitted on scores
of documents that the entries were not learned from.

Defined results: a null or empty text has no hits and gets the score of a text without hits.
Rows are scored each for itself, so repeated rows agree. Without labels of both kinds nothing
is learned and every score is the share of toxic labels (0 without labels). Other columns are
passed on by `score_documents` and never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from patronlens.llm.common import fresh
from patronlens.llm.labelled import training_texts

#: Labelled documents to learn from, at most; entries of the lexicon, at most.
MAX_LABELLED = 20_000
MAX_ENTRIES = 4_000
#: Beginnings of words of these lengths can be entries.
BEGINNINGS = range(3, 9)
FOLDS = 4
#: Phrases that hold an entry without being toxic; learned ones come on top.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "sore loser")
# Letters of other scripts that look like Latin ones.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ł": "l",
}
# Digits and signs that stand in for letters.
STAND_IN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INVISIBLE = {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
FOLD = str.maketrans(LOOK_ALIKE) | str.maketrans(STAND_IN) | INVISIBLE
BETWEEN = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Words in folded form, each between single spaces."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {BETWEEN.sub(' ', text.lower().translate(FOLD)).strip()} "


def entries_of(words: set[str]) -> set[str]:
    """What a document gives to the lexicon: its words, and how its words begin."""
    found = {f" {w} " for w in words}
    for n in BEGINNINGS:
        found.update([f" {w[:n]}" for w in words if len(w) >= n])
    return found


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (entry, weight))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase} ", (f" {phrase} ", None))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """The heaviest entry that begins at each word, without words in exception phrases."""
        automaton = self.automaton()
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(automaton):
            for end, (entry, weight) in automaton.iter(folded):
                start = end - len(entry) + 1
                if weight is None:
                    spared.append((start, end))
                elif weight > best.get(start, 0.0):
                    best[start] = weight
        for start, end in spared:
            for at in [a for a in best if start <= a < end]:
                del best[at]
        return best

    def features(self, folded: str) -> tuple[float, float, float]:
        best = self.hits(folded)
        if not best:
            return 0.0, 0.0, 0.0
        total = sum(best.values())
        return np.log1p(total), total / np.sqrt(folded.count(" ")), max(best.values())


def _fold_of(doc_ids: pa.Array) -> list[int]:
    import zlib

    return [zlib.crc32(f"fold {d}".encode()) % FOLDS for d in doc_ids.to_pylist()]


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, fold, toxic, n): partial document counts, given out before they grow large."""
    counts: defaultdict[tuple[str, int, int], int] = defaultdict(int)

    def out() -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([k[2] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["entry", "fold", "toxic", "n"],
        )

    for batch in batches:
        rows = zip(_fold_of(batch.column("doc_id")), batch.column("text").to_pylist(), batch.column("label").to_pylist())
        for part, text, label in rows:
            toxic = int(label > 0)
            for entry in entries_of(set(fold(text).split())):
                counts[entry, part, toxic] += 1
            if len(counts) > 300_000:
                yield out()
                counts.clear()
    yield out()


def _weights(entries: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log odds of entries that mark toxic documents clearly; of nested ones the shortest pure one."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    # A lower bound of the log odds, so that rare entries count for less.
    sure = odds - 1.64 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)).clip(0, 2)
    # Copies of one toxic document give its rare words a few counts; with more labels, more are asked for.
    good = np.flatnonzero((toxic >= max(3, 0.004 * n_toxic)) & (sure > 1.5))
    order = good[np.argsort(-sure[good], kind="stable")][:MAX_ENTRIES]
    return {entries[i]: float(sure[i]) for i in order}


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray  # constant, then one for each feature

    def score(self, text: str | None) -> float:
        z = self.coefficients[0] + float(np.dot(self.coefficients[1:], self.lexicon.features(fold(text or ""))))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a few features, halved until the penalised loss falls."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-4] + [ridge] * (x.shape[1] - 1))

    def loss(b: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ b).sum() - y @ (x @ b) + b @ penalty @ b / 2)

    b = np.zeros(x.shape[1])
    now = loss(b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ b)
        while np.abs(step).max() > 1e-9 and not loss(b + step) < now:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        b, now = b + step, loss(b + step)
    return b


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    parts: int = 5,
    rest: int = 0,
) -> Model:
    """Lexicon and score from labels of documents whose crc32 of the id mod parts is not rest."""
    sample = training_texts(docs, labels, label_col, max_labelled, parts, rest, id_col, text_col)
    counted = sample.mapInArrow(_count_entries, "entry string, fold int, toxic int, n long")
    sums = [
        F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{t}_{f}")
        for t in (1, 0) for f in range(FOLDS)
    ]
    toxic_total = sum(F.col(f"n1_{f}") for f in range(FOLDS))
    clean_total = sum(F.col(f"n0_{f}") for f in range(FOLDS))
    table = (
        counted.groupBy("entry").agg(*sums)
        .where((toxic_total >= 3) & (toxic_total * 4 > clean_total))
        .orderBy(toxic_total.desc(), "entry").limit(20 * MAX_ENTRIES).toPandas()
    )
    entries = table["entry"].tolist()
    toxic = table[[f"n1_{f}" for f in range(FOLDS)]].to_numpy(np.float64)
    clean = table[[f"n0_{f}" for f in range(FOLDS)]].to_numpy(np.float64)
    per_fold = np.zeros((FOLDS, 2), np.int64)
    rows = sample.select("doc_id", "label").mapInArrow(_fold_sizes, "fold int, toxic int, n long")
    for row in rows.groupBy("fold", "toxic").agg(F.sum("n").alias("n")).collect():
        per_fold[row["fold"], row["toxic"]] = row["n"]
    n_clean, n_toxic = per_fold.sum(0)
    if not n_clean or not n_toxic:
        share = float(n_toxic) / max(1, n_toxic + n_clean)
        return Model(Lexicon({}), np.array([30.0 if share == 1 else -30.0, 0, 0, 0]))
    # For each fold, a lexicon of the other folds; its scores do not know the labels.
    blind = []
    for f in range(FOLDS):
        others = [g for g in range(FOLDS) if g != f]
        blind.append(Lexicon(_weights(entries, toxic[:, others].sum(1), clean[:, others].sum(1),
                                      *per_fold[others].sum(0)[::-1]), EXCEPTIONS))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, phrases = [], []
            folds = _fold_of(batch.column("doc_id"))
            for f, text in zip(folds, batch.column("text").to_pylist()):
                folded = fold(text)
                found.append(blind[f].features(folded))
                phrases.append(sorted(_phrases(folded, blind[f].hits(folded))))
            a, b, c = np.array(found).reshape(-1, 3).T.copy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b), pa.array(c), pa.array(phrases, pa.list_(pa.string())), batch.column("label")],
                names=["a", "b", "c", "phrases", "label"],
            )

    judged = sample.mapInArrow(judge, "a double, b double, c double, phrases array<string>, label int").toPandas()
    tally: defaultdict[str, list[int]] = defaultdict(lambda: [0, 0])
    for found, label in zip(judged["phrases"], judged["label"]):
        for phrase in found:
            tally[phrase][int(label > 0)] += 1
    learned = sorted(p for p, (n0, n1) in tally.items() if n0 >= 3 and n0 > 20 * n1)
    lexicon = Lexicon(_weights(entries, toxic.sum(1), clean.sum(1), n_toxic, n_clean), (*EXCEPTIONS, *learned))
    x = judged[["a", "b", "c"]].to_numpy(np.float64)
    return Model(lexicon, _logistic(x, (judged["label"].to_numpy() > 0).astype(np.float64)))


def _phrases(folded: str, hits: dict[int, float]) -> set[str]:
    """The pairs of words around each hit."""
    found = set()
    for at in hits:
        end = folded.index(" ", at + 1)
        word = folded[at + 1 : end]
        before = folded[:at].rpartition(" ")[2]
        after = folded[end + 1 :].partition(" ")[0]
        found.update([f"{before} {word}"] * bool(before) + [f"{word} {after}"] * bool(after))
    return found


def _fold_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        folds = np.array(_fold_of(batch.column("doc_id")), np.int64)
        label = (batch.column("label").to_numpy() > 0).astype(np.int64)
        n = np.bincount(folds * 2 + label, minlength=2 * FOLDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(FOLDS), 2).astype(np.int32)),
             pa.array(np.tile([0, 1], FOLDS).astype(np.int32)), pa.array(n)],
            names=["fold", "toxic", "n"],
        )


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with one more column, the score."""
    score_col = fresh(docs.columns, score_col)
    schema = StructType([*docs.schema.fields]).add(score_col, DoubleType())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            scores = pa.array([model.score(t) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(judge, schema)
