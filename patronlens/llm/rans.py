"""Token ids in files: static range asymmetric numeral system with interleaved states.

`write_ids` counts all ids of the corpus, makes one shared frequency table, and writes blocks
in ascending order of doc_id. A block holds whole documents, about `block_ids` ids, and can be
decoded without any other. Its ids are dealt over `lanes` coder states that advance together,
so numpy codes one step of all lanes at a time. Every `checkpoint` steps the states and the
place in the stream are noted, so that parts of a block can be decoded apart (`decode_block`
with first and last step). Two checksums guard the coded bytes and the ids.

Layout of a folder, all of it written and read by Spark:
  blocks/  part, block, at (ids before it in its part), doc_ids, lengths, payload
  table/   id, frequency (they add up to 2**20)
  index/   part, base (ids in all parts before it)

Defined results: a null or empty text is the end id alone. A null id comes first. Rows with
equal ids follow each other in any order, each with its own place. No rows make empty files,
and reading these gives no rows. Other columns are not written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from patronlens.llm.common import stored
from patronlens.llm.tokens import END_ID, default_tokenizer, encoder

PRECISION = 20  # frequencies add up to 2**PRECISION, so up to a million different ids
LOW = np.uint64(1 << 31)  # a state stays in [2**31, 2**63)
BLOCK_IDS = 1 << 19
LANES = 2048
CHECKPOINT = 128
MAGIC = b"PLR1"
HEAD = struct.Struct("<4sQIIIQ")  # magic, ids, lanes, steps between checkpoints, crc of ids, words


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**PRECISION, at least one for each id that occurs."""
    total, target = int(counts.sum()), 1 << PRECISION
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > target:
        raise ValueError("more different ids than the table can hold")
    freq = np.where(counts > 0, np.maximum(1, counts * (target / total)).astype(np.int64), 0)
    spare = target - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if spare > 0:
        freq[order[0]] += spare
    while spare < 0:  # rounding up rare ids took too much: frequent ones give it back
        give = np.minimum(freq[order] - 1, -(-(freq[order] * -spare) // target)).clip(0)
        give = np.where(np.cumsum(give) <= -spare, give, 0)
        if not give.any():
            give[np.argmax(freq[order] > 1)] = 1
        freq[order] -= give
        spare += int(give.sum())
    return freq


class Table:
    """The shared model: frequency and first slot of each id, and the id of each slot."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.ids = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_block(
    ids: np.ndarray, table: Table, lanes: int = LANES, checkpoint: int = CHECKPOINT
) -> bytes:
    n, shift, bits = len(ids), np.uint64(63 - PRECISION), np.uint64(PRECISION)
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        now = ids[step * lanes : (step + 1) * lanes]
        freq, x = table.freq[now], state[: len(now)]
        over = x >= freq << shift
        if over.any():
            out = x[over]
            words.append(out.astype(np.uint32))
            written += len(out)
            x = np.where(over, x >> np.uint64(32), x)
        turn = x // freq
        state[: len(now)] = (turn << bits) + (x - turn * freq) + table.first[now]
        if step % checkpoint == 0:
            marks.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    marks.reverse()
    body = b"".join(
        struct.pack("<Q", written - after) + states.astype("<u8").tobytes() for after, states in marks
    )
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    data = HEAD.pack(MAGIC, n, lanes, checkpoint, crc, written) + body + stream.astype("<u4").tobytes()
    return data + struct.pack("<I", zlib.crc32(data))


def decode_block(
    data: bytes, table: Table, first_mark: int = 0, last_mark: int | None = None
) -> np.ndarray:
    """The ids from checkpoint `first_mark` up to `last_mark`, by default of the whole block."""
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("the coded bytes of a block do not match their checksum")
    magic, n, lanes, checkpoint, crc, written = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    steps = -(-n // lanes)
    marks, size = -(-steps // checkpoint), 8 + 8 * lanes
    last_mark = marks if last_mark is None else min(last_mark, marks)
    if first_mark >= last_mark:
        return np.empty(0, np.uint32)
    here = HEAD.size + first_mark * size
    (at,) = struct.unpack_from("<Q", data, here)
    state = np.frombuffer(data, "<u8", lanes, here + 8).astype(np.uint64)
    stream = np.frombuffer(data, "<u4", written, HEAD.size + marks * size)
    low_bits, bits = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    out = np.empty(n, np.uint32)
    first, last = first_mark * checkpoint, min(last_mark * checkpoint, steps)
    for step in range(first, last):
        active = min(lanes, n - step * lanes)
        x = state[:active]
        slot = x & low_bits
        now = table.ids[slot]
        x = table.freq[now] * (x >> bits) + slot - table.first[now]
        under = np.flatnonzero(x < LOW)
        if len(under):
            x[under] = (x[under] << np.uint64(32)) | stream[at : at + len(under)]
            at += len(under)
        state[:active] = x
        out[step * lanes : step * lanes + active] = now
    ids = out[first * lanes : min(last * lanes, n)]
    if first_mark == 0 and last_mark == marks and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the ids of a block do not match their checksum")
    return ids


def _id_blocks(
    batches: Iterator[pa.RecordBatch], path: str, block_ids: int, names: list[str]
) -> Iterator[pa.RecordBatch]:
    """Sorted (doc_id, text) of one task to blocks of whole documents, ids not yet coded.

    How often the task has seen each id comes in a last row, block -1, which holds no documents.
    """
    encode, end = encoder(path).encode, np.asarray([END_ID], "<u4").tobytes()
    part, block, at = TaskContext.get().partitionId(), 0, 0
    kept: list[pa.Array] = []
    held: list[bytes] = []
    lengths: list[int] = []
    counts = np.zeros(0, np.int64)

    def row_of(type_: pa.DataType, number: int, data: bytes, seen: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        doc_ids = pa.concat_arrays(kept) if kept else pa.array([], type_)
        columns = [
            pa.array([part]), pa.array([number]), pa.array([at]), pa.array([sum(lengths)]),
            pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), doc_ids),
            pa.array([lengths], pa.list_(pa.int64())),
            pa.array([data], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), pa.array(seen, pa.int64())),
            pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.array(n, pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def flush(type_: pa.DataType) -> pa.RecordBatch:
        nonlocal counts
        data, none = b"".join(held), np.empty(0, np.int64)
        more = np.bincount(np.frombuffer(data, "<u4"), minlength=len(counts))
        more[: len(counts)] += counts
        counts = more
        return row_of(type_, block, data, none, none)

    size, type_ = 0, pa.int64()
    for batch in batches:
        doc_ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        type_ = doc_ids.type
        begun = 0
        for row, text in enumerate(texts):
            ids = encode(text or "") + end
            held.append(ids)
            lengths.append(len(ids) // 4)
            size += len(ids) // 4
            if size >= block_ids:
                kept.append(doc_ids.slice(begun, row + 1 - begun))
                begun = row + 1
                yield flush(type_)
                block, at, size = block + 1, at + size, 0
                kept, held, lengths = [], [], []
        if begun < len(texts):
            kept.append(doc_ids.slice(begun))
    if lengths:
        yield flush(type_)
        kept, lengths = [], []
    ids = np.flatnonzero(counts)
    if len(ids):
        yield row_of(type_, -1, b"", ids, counts[ids])


def write_ids(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    block_ids: int = BLOCK_IDS,
    lanes: int = LANES,
    checkpoint: int = CHECKPOINT,
) -> None:
    path = tokenizer or default_tokenizer()
    id_type = docs.schema[id_col].dataType
    schema = StructType()
    for name in ("part", "block", "at", "n"):
        schema.add(name, LongType())
    schema.add("doc_ids", ArrayType(id_type)).add("lengths", ArrayType(LongType())).add("ids", BinaryType())
    schema.add("seen", ArrayType(LongType())).add("times", ArrayType(LongType()))
    names = schema.names

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _id_blocks(batches, path, block_ids, names)

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    written = stored(ordered.mapInArrow(to_blocks, schema))
    blocks = written.where("block >= 0").drop("seen", "times")

    # One row for each id of the vocabulary: bounded, whatever the corpus.
    each = written.where("block < 0").select(F.inline(F.arrays_zip("seen", "times")))
    found = each.groupBy(F.col("seen").alias("id")).agg(F.sum("times").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    freq = quantised(counts)
    spark = docs.sparkSession
    rows = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(rows, "id long, frequency long").coalesce(1).write.parquet(f"{folder}/table")

    def to_payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids = np.frombuffer(one.column("ids")[0].as_buffer(), "<u4")
                payload = encode_block(ids, table, lanes, checkpoint)
                yield one.drop_columns(["ids"]).append_column("payload", pa.array([payload], pa.binary()))

    coded = StructType([f for f in blocks.schema if f.name != "ids"]).add("payload", BinaryType())
    blocks.mapInArrow(to_payload, coded).write.option("compression", "none").parquet(f"{folder}/blocks")
    # One row for each task that wrote: a handful against the documents, so one window does.
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    bases, base = [], 0
    for part in parts:
        bases.append((part["part"], base))
        base += part["n"]
    spark.createDataFrame(bases, "part long, base long").coalesce(1).write.parquet(f"{folder}/index")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    rows = spark.read.parquet(f"{folder}/table").collect()
    freq = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        freq[r["id"]] = r["frequency"]
    bases = {r["part"]: r["base"] for r in spark.read.parquet(f"{folder}/index").collect()}
    schema = StructType().add("doc_id", blocks.schema["doc_ids"].dataType.elementType)
    for name in ("start", "n_tokens", "ids_crc32"):
        schema.add(name, LongType())
    if with_ids:
        schema.add("ids", BinaryType())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for row in range(batch.num_rows):
                data = decode_block(batch.column("payload")[row].as_py(), table).astype("<u4").tobytes()
                lengths = batch.column("lengths")[row].values.to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                cuts = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                base = bases[batch.column("part")[row].as_py()] + batch.column("at")[row].as_py()
                columns = [
                    batch.column("doc_ids")[row].values, pa.array(base + starts),
                    pa.array(lengths), pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(cuts, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return blocks.select("part", "at", "doc_ids", "lengths", "payload").mapInArrow(decode, schema)
