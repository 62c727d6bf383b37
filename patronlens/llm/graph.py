"""Links between rows: connected components, and groups dealt out in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (a, b) edges; the component is its smallest node.

    Large-star and small-star steps in turn until every node hangs on its smallest one. A step
    is two joins and counts on edges, so no task ever holds the edges of a node.
    """
    a, b = F.col("a"), F.col("b")
    current = stored(
        edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    while not _all_stars(current):
        both = current.unionByName(current.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(parent, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        current = stored(moved.unionByName(parent.select("a", F.col("m").alias("b"))).distinct())
    children = current.select(a.alias("node"), b.alias("component"))
    return children.unionByName(current.select(b.alias("node"), b.alias("component")).distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node has one parent and no parent has a parent."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bad.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def in_blocks(members: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """members with columns block_a and block_b, sorted so that equal (key, block_a, block_b)
    follow each other in one task.

    A group of up to `most` rows is one block, (0, 0). A larger one is dealt over several by hash of
    the item, and its rows are repeated for each pair of blocks, so every two rows of a group meet
    in one place, and no place has more than about twice `most` rows. The row's own block is `own`.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("size"))
    groups = sizes.where("size > 1").select(
        F.col(key).alias("of_key"), F.ceil(F.col("size") / most).cast("int").alias("blocks")
    )
    joined = members.join(groups, F.col(key) == F.col("of_key")).drop("of_key")
    own = F.pmod(F.xxhash64(item, F.lit("block")), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = joined.withColumn("own", own).withColumn("other", other).select(
        *members.columns, "own",
        F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"),
    )
    return dealt.repartition(key, "block_a", "block_b").sortWithinPartitions(key, "block_a", "block_b", item)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Sorted batches as tables that hold whole groups, with the (first, end) of each group."""
    import numpy as np

    kept: pa.Table | None = None

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for key in keys:
            values = table[key].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        starts = cut(table)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last), list(zip(starts[:-1].tolist(), starts[1:].tolist()))
        kept = table.slice(last)
    if kept is not None:
        yield kept, [(0, kept.num_rows)]
