"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

Equal vectors are one class first. A class is normalised and hashed into several tables: each
hash is `projections` random projections, shifted and cut into steps of `width`. Classes that
share a bucket are compared by their exact cosine in double precision, in blocks of bounded
size, so a bucket that holds a large share of all rows is spread over many tasks. A link found
in several tables counts once, in the first of them, which each side knows from its own hashes.
A block gives out counts and the smallest member of what it has joined, never its pairs.

The number of projections follows from the number of classes (about `occupancy` unrelated
classes in a bucket), the number of tables from it so that two vectors at exactly the threshold
meet with probability `recall`. An exactly dense group still costs the square of its distinct
vectors in comparisons, as its counts of links need them.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components have no links,
and neither have vectors of different lengths. Rows that share an id are one vertex for
components, while each row counts as a vector for n_links. A row with null id links with nothing
and is kept. No rows give no rows. Other columns, such as labels, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patronlens.llm.common import stored
from patronlens.llm.graph import connected_components, in_blocks, runs

COSINE = 0.95
WIDTH = 1.5
RECALL = 0.995
OCCUPANCY = 16
BLOCK = 1024
SEED = 41


def collision(distance: float, width: float) -> float:
    """Probability that one projection puts two points at this distance into the same step."""
    r = width / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(classes: int, cosine: float, width: float, recall: float, occupancy: int) -> tuple[int, int]:
    """(projections, tables) for so many classes."""
    near = collision(math.sqrt(2 - 2 * cosine), width)
    far = collision(math.sqrt(2), width)
    projections = max(2, math.ceil(math.log(max(classes, 1) / occupancy + 1) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log1p(-(near**projections)))


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class key and double components of usable vectors; null otherwise."""
    for batch in batches:
        keys, vectors = [], []
        for values in batch.column("vector").to_pylist():
            v = None
            if values and None not in values:
                v = np.asarray(values, np.float64) + 0.0  # no negative zero
                # Scaled by the largest first, so that squares neither vanish nor overflow.
                top = np.abs(v).max()
                v = v / top if np.isfinite(top) and top > 0 else None
            data = None if v is None else (v / np.linalg.norm(v)).astype("<f8").tobytes()
            keys.append(None if data is None else hashlib.blake2b(data, digest_size=16).digest())
            vectors.append(data)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())],
            names=["id", "key", "unit"],
        )


def _hasher(dims_seed: int, projections: int, tables: int, width: float):
    """Batches of classes to one row for each class and table."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mixer = np.random.default_rng(dims_seed + 1).integers(1, 1 << 63, projections, np.int64) | 1
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                units = [np.frombuffer(u.as_buffer(), "<f8") for u in batch.column("unit")]
                codes = np.empty((len(units), tables), np.int64)
                for dims in {len(u) for u in units}:
                    if dims not in planes:
                        rng = np.random.default_rng([dims_seed, dims])
                        planes[dims] = (rng.normal(size=(dims, tables * projections)),
                                        rng.uniform(0, width, tables * projections))
                    a, shift = planes[dims]
                    rows = [i for i, u in enumerate(units) if len(u) == dims]
                    steps = np.floor((np.stack([units[i] for i in rows]) @ a + shift) / width).astype(np.int64)
                    mixed = (steps.reshape(len(rows), tables, projections) * mixer).sum(2)
                    codes[rows] = mixed * 1_000_003 + np.arange(tables) * 0x5851F42D4C957F2D + dims
                packed = pa.array([c.astype("<i8").tobytes() for c in codes], pa.binary())
                order = np.tile(np.arange(len(units)), tables)
                take = pa.array(order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes.T.ravel()), pa.array(np.repeat(np.arange(tables, dtype=np.int32), len(units))),
                     batch.column("rep").take(take), batch.column("size").take(take),
                     batch.column("unit").take(take), packed.take(take)],
                    names=["bucket", "table", "rep", "size", "unit", "codes"],
                )

    return hashed


def _compare(cosine: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rep, links, root): links found first in this block, smallest class it joins."""
        for table, groups in runs(batches, ["bucket", "block_a", "block_b"]):
            reps, sizes = table["rep"].to_numpy(), table["size"].to_numpy()
            own, units, codes = table["own"].to_numpy(), table["unit"], table["codes"]
            number, first_block = table["table"].to_numpy(), table["block_a"].to_numpy()
            last_block = table["block_b"].to_numpy()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for first, end in groups:
                if end - first < 2:
                    continue
                raw = [units[i].as_buffer() for i in range(first, end)]
                if len({r.size for r in raw}) > 1:
                    continue  # a chance meeting of vectors of different lengths
                v = np.stack([np.frombuffer(r, "<f8") for r in raw])
                near = v @ v.T >= cosine
                if first_block[first] != last_block[first]:
                    near &= own[first:end, None] != own[None, first:end]
                np.fill_diagonal(near, False)
                rows = np.flatnonzero(near.any(1))
                if not len(rows):
                    continue
                near, at = near[np.ix_(rows, rows)], first + rows
                label = reps[at].copy()
                while True:  # labels only fall, and there are at most as many as rows
                    least = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
                    if (least == label).all():
                        break
                    label = least
                hashes = np.stack([np.frombuffer(codes[int(i)].as_buffer(), "<i8") for i in at])
                new = near.copy()
                for t in range(int(number[first])):
                    new &= hashes[:, None, t] != hashes[None, :, t]
                out.append((reps[at], new @ sizes[at], label))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["rep", "links", "root"]
                )

    return compared


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    width: float = WIDTH,
    recall: float = RECALL,
    occupancy: int = OCCUPANCY,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    id_type = vectors.schema[id_col].dataType
    schema = StructType().add("id", id_type).add("key", "binary").add("unit", "binary")
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    rows = stored(own.mapInArrow(_prepare, schema))
    usable = rows.where(F.col("id").isNotNull() & F.col("key").isNotNull())
    classes = stored(
        usable.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.any_value("unit").alias("unit"))
    )
    projections, tables = table_plan(classes.count(), cosine, width, recall, occupancy)
    members = classes.select("rep", "size", "unit").mapInArrow(
        _hasher(SEED, projections, tables, width),
        "bucket long, table int, rep long, size long, unit binary, codes binary",
    )
    found = stored(
        in_blocks(members, "bucket", "rep", block).mapInArrow(_compare(cosine), "rep long, links long, root long")
    )
    links = found.groupBy(F.col("rep").alias("of_rep")).agg(F.sum("links").alias("links"))
    # Classes of rows that share an id hang together through it.
    shared = usable.join(classes.select("key", "rep"), "key").where("id != rep").select(
        F.col("id").alias("a"), F.col("rep").alias("b")
    )
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(shared)
    components = connected_components(edges)
    by_class = classes.select("key", "rep", "size").join(links, F.col("rep") == F.col("of_rep"), "left").select(
        F.col("key").alias("of_key"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    with_links = rows.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(
        by_class, F.col("key") == F.col("of_key"), "left"
    )
    return with_links.join(components, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
