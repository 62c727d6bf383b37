"""Line dedup that can be taken back: exact reference counts behind sharded cuckoo filters.

A line's key is the line without white space at both ends, with A-Z in lower case. `LineIndex`
holds how many documents have each key (as a 128-bit hash) and, in shards by that hash, cuckoo
filters of the keys in at least `min_docs` documents. `insert` and `delete` add and take away
documents: the counts change exactly, and the filters take in or give up the keys that cross the
threshold, so deleting what was inserted leaves an index that answers as before. Each state is
written anew to the shared folder; the one before stays readable, and a lost executor costs its
own tasks only.

`drop_repeated_lines` reads whole texts once, without moving them: lines are probed in the filters,
and the few keys below the threshold that a filter takes for present come along as a set of
exceptions. Filters and exceptions are broadcast up to a measured size; beyond it the keys of lines
are joined with the counts instead, with the same result.

Defined results: a null or empty text is one empty line, and an empty line has no key to count. A
row is a document, so repeated rows and rows that share an id count each. Null ids are rows like all
others. Very long texts are split whole. Empty tables give an empty index and no rows. Other columns
stay as they are, whatever their names. Two different lines are confused with a probability of
2^-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from patronlens.llm.common import fresh, stored
from patronlens.llm.shingles import mixed

MIN_DOCS = 10
MIN_CHARS = 1
SHARD_KEYS = 1 << 15  # keys a filter is laid out for
SLOTS = 4
PRINT_BITS = 16  # at most; fewer bits only make more exceptions
KICKS = 500
FLUSH_KEYS = 200_000  # keys a task holds before it hands their counts on
MAX_BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1 / 4096


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # on bytes both touch ASCII alone


def _long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < max(1, min_chars):
        return False
    return len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars


def hashed(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _places(keys: Iterable[bytes], shards: int, bits: int = PRINT_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, fingerprint, first bucket before masking) of hashed keys."""
    halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    prints = halves[:, 0] & np.uint64((1 << bits) - 1)
    prints = np.maximum(prints, np.uint64(1))  # 0 marks a free slot
    return (halves[:, 0] >> np.uint64(32)) % np.uint64(shards), prints, halves[:, 1]


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may lie in either of two buckets."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells.reshape(-1, SLOTS)

    @classmethod
    def of(cls, prints: np.ndarray, firsts: np.ndarray, buckets: int = 8) -> CuckooFilter:
        """A filter that holds all these keys, as large as that takes."""
        while buckets * SLOTS * 0.9 < len(prints):
            buckets *= 2
        made = cls(np.zeros(buckets * SLOTS, np.uint16))
        for one, first in zip(prints.tolist(), firsts.tolist()):
            if not made.insert(one, first):
                return cls.of(prints, firsts, 2 * buckets)
        return made

    def _buckets(self, one: int, first: int) -> tuple[int, int]:
        mask = len(self.cells) - 1
        here = first & mask
        return here, here ^ (int(mixed(np.uint64(one))) & mask)

    def insert(self, one: int, first: int) -> bool:
        """False where no room was found: the filter must then be built anew."""
        here, there = self._buckets(one, first)
        for bucket in (here, there):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = one
                return True
        for kick in range(KICKS):
            slot = (kick + one) % SLOTS
            one, self.cells[there, slot] = int(self.cells[there, slot]), one
            there = self._buckets(one, there)[1]
            free = np.flatnonzero(self.cells[there] == 0)
            if len(free):
                self.cells[there, free[0]] = one
                return True
        return False

    def delete(self, one: int, first: int) -> bool:
        """Take one copy of a key that was inserted."""
        for bucket in self._buckets(one, first):
            held = np.flatnonzero(self.cells[bucket] == one)
            if len(held):
                self.cells[bucket, held[0]] = 0
                return True
        return False


class Filters:
    """All shards side by side, probed for many keys at once."""

    def __init__(self, shards: int, rows: list[tuple[int, bytes]], bits: int = PRINT_BITS) -> None:
        self.shards, self.bits = shards, bits
        self.base, self.mask = np.zeros(shards, np.uint64), np.zeros(shards, np.uint64)
        cells, at = [np.zeros(SLOTS, np.uint16)], 1  # a shard without keys looks into an empty bucket
        for shard, data in rows:
            cells.append(np.frombuffer(data, "<u2"))
            self.base[shard], self.mask[shard] = at, len(cells[-1]) // SLOTS - 1
            at += len(cells[-1]) // SLOTS
        self.cells = np.concatenate(cells).reshape(-1, SLOTS)

    def probe(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        shard, prints, first = _places(keys, self.shards, self.bits)
        base, mask, small = self.base[shard], self.mask[shard], prints.astype(np.uint16)[:, None]
        here = first & mask
        there = here ^ (mixed(prints) & mask)
        return (self.cells[base + here] == small).any(1) | (self.cells[base + there] == small).any(1)


@dataclass(frozen=True)
class LineIndex:
    """A state: counts (key, n_docs), filters (shard, cells), and the keys they wrongly take for present."""

    counts: DataFrame
    filters: DataFrame
    exceptions: DataFrame
    shards: int
    min_docs: int
    min_chars: int
    print_bits: int = PRINT_BITS


def _line_counts(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(key, n): in how many rows each key stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            keys = [(hashed(k), n) for k, n in held.items() if _long_enough(k, min_chars)]
            held.clear()
            return pa.record_batch(
                [pa.array([k for k, _ in keys], pa.binary()), pa.array([n for _, n in keys], pa.int64())],
                ["key", "n"],
            )

        for batch in batches:
            for text in batch.column(0):
                held.update({line_key(line) for line in (text.as_py() or b"").split(b"\n")})
                if len(held) > FLUSH_KEYS:
                    yield flush()
        yield flush()

    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _shard(shards: int) -> Column:
    """The shard of a hashed key, as `_places` computes it from bytes 4 to 7, little-endian."""
    byte = [F.conv(F.substring(F.hex("key"), 9 + 2 * i, 2), 16, 10).cast("long") for i in range(4)]
    return (sum((b * (1 << (8 * i)) for i, b in enumerate(byte)), F.lit(0)) % shards).cast("int")


def empty_index(
    spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, print_bits: int = PRINT_BITS
) -> LineIndex:
    return LineIndex(
        spark.createDataFrame([], "key binary, n_docs long"),
        spark.createDataFrame([], "shard int, cells binary"),
        spark.createDataFrame([], "key binary"),
        1, min_docs, min_chars, print_bits,
    )


def _changed(index: LineIndex, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
    delta = _line_counts(docs, text_col, index.min_chars).select("key", (sign * F.col("n")).alias("n"), F.lit(0).alias("old"))
    old = index.counts.select("key", F.col("n_docs").alias("n"), F.col("n_docs").alias("old"))
    total = old.unionByName(delta).groupBy("key").agg(F.sum("n").alias("n_docs"), F.sum("old").alias("old"))
    checked = F.when(F.col("n_docs") < 0, F.raise_error(F.lit("a deleted document was never inserted")))
    counts = stored(total.withColumn("n_docs", F.coalesce(checked.cast("long"), "n_docs")))

    least, bits = index.min_docs, index.print_bits
    crossed = counts.where(F.greatest("n_docs", "old") >= least)
    many = crossed.count()
    shards = index.shards
    while shards * SHARD_KEYS < many:
        shards *= 2
    filters = index.filters if shards == index.shards else index.filters.where(F.lit(False))

    def renew(held: pa.Table, rows: pa.Table) -> pa.Table:
        shard = (rows if rows.num_rows else held).column("shard")[0].as_py()
        keys, old_n = rows.column("key").to_pylist(), rows.column("old").to_numpy()
        after = rows.column("n_docs").to_numpy() >= least
        before = (old_n >= least) & bool(held.num_rows)
        _, prints, firsts = _places(keys, shards, bits)
        made = None
        if held.num_rows:
            made = CuckooFilter(np.frombuffer(held.column("cells")[0].as_py(), "<u2").copy())
            for i in np.flatnonzero(before & ~after):
                made.delete(int(prints[i]), int(firsts[i]))
            fits = all(made.insert(int(prints[i]), int(firsts[i])) for i in np.flatnonzero(after & ~before))
            made = made if fits else None
        if made is None:
            made = CuckooFilter.of(prints[after], firsts[after])
        return pa.table({"shard": pa.array([shard], pa.int32()), "cells": pa.array([made.cells.astype("<u2").tobytes()])})

    rows = crossed.withColumn("shard", _shard(shards))
    new = filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(renew, "shard int, cells binary")
    new = stored(new)
    below = counts.where((F.col("n_docs") > 0) & (F.col("n_docs") < least)).select("key")
    return LineIndex(
        counts.where("n_docs > 0").select("key", "n_docs"), new,
        stored(_taken_for_present(below, new, shards, bits)), shards, least, index.min_chars, bits,
    )


def _taken_for_present(below: DataFrame, filters: DataFrame, shards: int, bits: int) -> DataFrame:
    """Those of the keys that a filter holds by mistake."""
    if _bytes(filters, below.where(F.lit(False))) > MAX_BROADCAST_BYTES:
        return below.where(F.lit(False))  # such an index is never broadcast, so nobody probes it
    probe = below.sparkSession.sparkContext.broadcast(_collected(filters, shards, bits))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probe.value.probe(batch.column(0).to_pylist())))

    return below.mapInArrow(screen, "key binary")


def _collected(filters: DataFrame, shards: int, bits: int) -> Filters:
    return Filters(shards, [(r.shard, bytes(r.cells)) for r in filters.collect()], bits)


def _bytes(filters: DataFrame, exceptions: DataFrame) -> int:
    cells = filters.agg(F.sum(F.length("cells"))).head()[0] or 0
    return cells + 100 * exceptions.count()  # a key in a Python set


def insert(index: LineIndex, docs: DataFrame, text_col: str = "text") -> LineIndex:
    """The index with these documents added."""
    return _changed(index, docs, text_col, 1)


def delete(index: LineIndex, docs: DataFrame, text_col: str = "text") -> LineIndex:
    """The index without these documents; it is an error if they were not inserted."""
    return _changed(index, docs, text_col, -1)


def drop_repeated_lines(
    docs: DataFrame,
    index: LineIndex,
    text_col: str = "text",
    known: bool = False,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """docs with the lines dropped whose key stands in `min_docs` documents of the index or more.

    Adds n_lines (before dropping) and n_dropped. `known` says that all of docs are in the index;
    otherwise lines that only a filter knows are looked up in the counts first.
    """
    if _bytes(index.filters, index.exceptions) > max_broadcast_bytes:
        return _dropped_by_join(docs, index, text_col)
    spark = docs.sparkSession
    filters = _collected(index.filters, index.shards, index.print_bits)
    wrong = {bytes(r.key) for r in index.exceptions.collect()}
    if not known:
        keys = _line_counts(docs, text_col, index.min_chars).join(index.counts, "key", "left_anti").select("key")
        found = stored(_taken_for_present(keys, index.filters, index.shards, index.print_bits))
        if _bytes(index.filters, index.exceptions.union(found)) > max_broadcast_bytes:
            return _dropped_by_join(docs, index, text_col)
        wrong |= {bytes(r.key) for r in found.collect()}
    held, min_chars = spark.sparkContext.broadcast((filters, wrong)), index.min_chars

    def drop(keyed: list[list[bytes]]) -> list[set[bytes]]:
        probe, not_present = held.value
        keys = [k for k in {key for keys in keyed for key in keys} if _long_enough(k, min_chars)]
        hashes = [hashed(k) for k in keys]
        found = probe.probe(hashes)
        out = {keys[i] for i in np.flatnonzero(found) if hashes[i] not in not_present}
        return [out] * len(keyed)

    return _applied(docs, text_col, drop)


def _applied(docs: DataFrame, text_col: str, drop: Callable[..., list[set[bytes]]], also: str | None = None) -> DataFrame:
    """Cut the texts in Arrow batches. `drop` is given the line keys of a batch's texts, and the
    values of column `also` if there is one, and names the keys that each text loses."""
    rest = [c for c in docs.columns if c not in (text_col, also)]
    extra = [fresh(docs.columns, name) for name in ("n_lines", "n_dropped")]
    sent = docs.select(*rest, F.col(text_col).cast("binary").alias(text_col), *([also] if also else []))
    schema = StructType([sent.schema[c] for c in (*rest, text_col)])
    for name in extra:
        schema = schema.add(name, LongType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(t or b"").split(b"\n") for t in batch.column(len(rest)).to_pylist()]
            keyed = [[line_key(line) for line in lines] for lines in split]
            gone = drop(keyed, batch.column(len(rest) + 1).to_pylist()) if also else drop(keyed)
            kept = [
                [line for line, key in zip(lines, keys) if key not in out]
                for lines, keys, out in zip(split, keyed, gone)
            ]
            yield pa.record_batch(
                [
                    *batch.columns[: len(rest)],
                    pa.array([b"\n".join(lines) for lines in kept], pa.binary()),
                    pa.array([len(lines) for lines in split], pa.int64()),
                    pa.array([len(a) - len(b) for a, b in zip(split, kept)], pa.int64()),
                ],
                [*rest, text_col, *extra],
            )

    done = sent.mapInArrow(cut, schema).withColumn(text_col, F.col(text_col).cast("string"))
    return done.select(*[c for c in docs.columns if c != also], *extra)


def _dropped_by_join(docs: DataFrame, index: LineIndex, text_col: str) -> DataFrame:
    """The way for filters too large to broadcast: line keys are joined with the counts.

    Keys with more than a 4096th of all references, fewer than 4096, go to each task as a set, so no
    key brings more rows together; rows are told apart by a number, so no text does either.
    """
    row, own = fresh(docs.columns, "row_number"), fresh(docs.columns, "own_keys")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    dropped = index.counts.where(F.col("n_docs") >= index.min_docs)
    total = index.counts.agg(F.sum("n_docs")).head()[0] or 0
    hot = {bytes(r.key) for r in dropped.where(F.col("n_docs") > total * HOT_SHARE).select("key").collect()}
    min_chars = index.min_chars

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, found = [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = {line_key(line) for line in (text or b"").split(b"\n")}
                keys = [h for h in (hashed(k) for k in keys if _long_enough(k, min_chars)) if h not in hot]
                numbers += [number] * len(keys)
                found += keys
            yield pa.record_batch([pa.array(numbers, pa.int64()), pa.array(found, pa.binary())], ["row", "key"])

    pairs = numbered.select(row, F.col(text_col).cast("binary")).mapInArrow(keys_of, "row long, key binary")
    lists = pairs.join(dropped.select("key"), "key").groupBy("row").agg(F.collect_list("key").alias(own))
    joined = numbered.join(lists.withColumnRenamed("row", row), row, "left").select(*docs.columns, own)

    def drop(keyed: list[list[bytes]], keys_own: list[list[bytes] | None]) -> list[set[bytes]]:
        out = []
        for keys, mine in zip(keyed, keys_own):
            known = hot.union(mine or ())
            out.append({k for k in set(keys) if _long_enough(k, min_chars) and hashed(k) in known})
        return out

    return _applied(joined, text_col, drop, also=own)
