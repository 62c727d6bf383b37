"""Best-fit packing with certified repacking.

Documents become token pieces; a full piece is a sequence of its own. The others are dealt out
evenly over partitions of about `part_rows` pieces. Each partition is packed by best-fit
decreasing, and a lower bound from dual-feasible functions certifies its number of sequences.
Where they differ, the partition gives the documents of its least filled sequences to an
exchange, in which groups of `merge` partitions pack them together by the same rule, until
one group is left. A certified partition gives away only a last sequence under half full.
Each task holds one partition or what a few partitions gave, both bounded.

Defined results: a null or empty text is the end id alone. Repeated rows and rows with a null
id are packed each for itself. No rows give no sequences. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patronlens.llm.common import stored
from patronlens.llm.tokens import default_tokenizer, piece_batches

CAPACITY = 4096
PART_ROWS = 20_000
MERGE = 8
#: Least filled sequences that a partition gives away: for each one over its bound, and at most.
RELEASE_FOR_EACH, RELEASE_MOST = 24, 512
PACKED = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "sequence_id", "offset", "given"]


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that still takes it."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set when a bin has room for exactly r more
    count = 0
    order = np.argsort(-lengths, kind="stable")
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen, count = capacity, count, count + 1
        left = room - length
        if left:
            by_room[left].append(chosen)
            rooms |= 1 << left
        bins[item] = chosen
    return bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: the best of two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    # Items over capacity - t count as whole bins, items under t as nothing.
    cuts = np.unique(np.concatenate([sizes[2 * sizes <= capacity], capacity - sizes[2 * sizes > capacity]]))
    n_from = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    sum_from = np.concatenate([np.cumsum((sizes * counts)[::-1])[::-1], [0]])
    low = np.searchsorted(sizes, cuts)
    high = np.searchsorted(sizes, capacity - cuts, side="right")
    if len(cuts):
        weights = n_from[high] * capacity + sum_from[low] - sum_from[high]
        best = max(best, -(-int(weights.max()) // capacity))
    # Multiples of capacity / (k + 1) keep their share, others are rounded down to k-ths.
    for k in range(1, 21):
        scaled, rest = np.divmod(sizes * (k + 1), capacity)
        shares = np.where(rest == 0, sizes * k, scaled * capacity)
        best = max(best, -(-int((shares * counts).sum()) // (k * capacity)))
    return best


def pack_group(table: pa.Table, round_no: int, last: bool, capacity: int) -> pa.Table:
    """One partition packed: rows get their sequence and place, or are given away."""
    lengths = table["length"].to_numpy().astype(np.int64)
    bins = best_fit_decreasing(lengths, capacity)
    fills = np.bincount(bins, weights=lengths).astype(np.int64)
    gap = len(fills) - lower_bound(lengths, capacity)
    given = np.zeros(len(fills), bool)
    if not last:
        order = np.argsort(fills, kind="stable")
        if gap > 0:
            given[order[: min(gap * RELEASE_FOR_EACH, RELEASE_MOST)]] = True
        elif 2 * fills[order[0]] < capacity:
            given[order[0]] = True
    group = int(table["part"][0].as_py())
    order = np.lexsort((np.arange(len(bins)), bins))
    ends = np.cumsum(lengths[order])
    firsts = np.concatenate([[0], np.cumsum(fills)[:-1]])
    offsets = np.empty(len(bins), np.int64)
    offsets[order] = ends - lengths[order] - firsts[bins[order]]
    ids = (np.int64(round_no) << 56) + (np.int64(group) << 24) + bins
    return (
        table.drop_columns(["sequence_id", "offset", "given"])
        .append_column("sequence_id", pa.array(ids))
        .append_column("offset", pa.array(offsets))
        .append_column("given", pa.array(given[bins]))
    )


def _packer(round_no: int, last: bool, capacity: int) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: pack_group(rows, round_no, last, capacity).select(PACKED)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    part_rows: int = PART_ROWS,
    merge: int = MERGE,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    id_type = docs.schema[id_col].dataType
    schema = StructType().add("doc_id", id_type)
    for name in ("piece", "start", "length", "ids_crc32"):
        schema.add(name, "integer" if name == "piece" else "long")

    def to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return piece_batches(batches, path, capacity)

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(texts.mapInArrow(to_pieces, schema))
    # Read from files, so a repeated task numbers its rows in the same way.
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") == capacity).select(
        *schema.names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = numbered.where(F.col("length") < capacity)
    parts = max(1, -(-pieces.where(F.col("length") < capacity).count() // part_rows))
    todo = rest.select(
        *schema.names,
        F.pmod(F.xxhash64("row"), F.lit(parts)).cast("long").alias("part"),
        F.lit(0).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(False).alias("given"),
    )
    done = [full]
    round_no = 0
    while True:
        round_no += 1
        last = parts == 1

        packed = stored(
            todo.groupBy("part").applyInArrow(_packer(round_no, last, capacity), todo.select(PACKED).schema)
        )
        columns = [*schema.names, "sequence_id", "offset"]
        done.append(packed.where(~F.col("given")).select(columns))
        if last:
            break
        parts = -(-parts // merge)
        todo = packed.where("given").withColumn("part", F.pmod(F.col("part"), F.lit(parts)))
    result = done[0]
    for other in done[1:]:
        result = result.unionByName(other)
    return result
