"""Prefix trie of conversations by truncation peeling.

A conversation is a sequence of turns; each distinct sequence of first turns is a node, the empty one
the root. Nodes are found from below: at the deepest level the conversations that end there are
merged into nodes, each node's last turn is stripped, and what is left is grouped with the
conversations that end one level higher, and so on up to the root. A node is complete when its
level has been grouped, so its figures are added up in the same descent that discovers it.

Scale. A turn is hashed where it is read (128 bits, role and text), so texts are never moved. Turns
are sorted by conversation and streamed through a chained hash, which names the node after each
turn; equal conversations become one path with a count. Paths are then dealt out in their sorted
order, so however popular an opening is, its conversations spread over many tasks. In a task every
node but those on its first and last path has all its members there; the others, a depth for
each task, go on as paths with partial figures, 32 tasks into one, until one task is left.
Conversations of more than `SEGMENT` turns are peeled segment by segment, the deepest first.
Intermediate tables are written to the shared folder.

Defined results: null roles and texts are empty. Turns are ordered by number, null first, those of
equal number by the MD5 of their content; repeated rows are turns of their own. Rows without
conversation id belong to no conversation and take no part. A conversation may be turnless, and then
ends at the root. Very long texts count whole. No rows make no nodes, not even a root. Other
columns are ignored. Ids must be whole numbers. Two different nodes are confused with a probability of
2^-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.llm.common import stored

SEGMENT = 1 << 16
TASK_TURNS = 50_000
FAN_IN = 32
SALTS = 16
ID_TEXT = 1 << 20  # bytes of joined ids in a row
SIZE = 16  # bytes of a node's name
ROOT = bytes(SIZE)
NO_ENDS = hashlib.sha256(b"").hexdigest()

PATH = "conv long, segment int, path binary, words array<long>, last boolean"
# A path, and figures for some of its nodes: `at` are positions on the path.
ITEM = (
    "path binary, words array<long>, at array<int>, n array<long>, low array<long>,"
    " kids array<long>, leaves array<long>, saved array<long>, ends array<string>"
)
NODE = (
    "name binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends_sha256 string, shared boolean"
)
RESULT = f"node struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in NODE.split(','))}>, item struct<" + ", ".join(
    p.strip().replace(" ", ": ", 1) for p in ITEM.split(",")
) + ">"


def turns(table: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Rows (conv, turn, name, words): the turns of each conversation, with hashed content."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return table.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(content)).alias("name"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def no_prefix(rows: DataFrame) -> DataFrame:
    """Each conversation as it is, in the form that `with_base_prefix` gives."""
    nothing = F.lit(None).cast("array<struct<name:binary,words:long>>")
    return rows.select("conv").distinct().select("conv", F.lit(0).alias("h"), nothing.alias("head"))


def with_base_prefix(rows: DataFrame, group: int, prefix: Column, longest: int) -> DataFrame:
    """(conv, h, head): the first h turns of a conversation come from the one that leads its group of ids.

    `prefix` gives h, at most `longest`, for column conv. A leader's first turns, `longest` at most,
    are all that is collected.
    """
    base = F.col("conv") - F.col("conv") % group
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "name"))
    first = rows.where(F.col("conv") == base).withColumn("place", place).where(F.col("place") <= longest)
    heads = first.groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "name", "words"))).alias("head")
    )
    convs = rows.select("conv").distinct().select("conv", base.alias("base"), prefix.cast("int").alias("h"))
    named = F.transform(F.slice("head", 1, F.col("h")), lambda t: F.struct(t["name"].alias("name"), t["words"].alias("words")))
    return convs.join(heads, "base", "left").select("conv", "h", named.alias("head"))


def _paths(rows: DataFrame, heads: DataFrame, segment: int) -> DataFrame:
    """The names of the nodes along each conversation, in segments, from turns streamed in order.

    A segment begins with the node that ends the one before, so that of the root begins with it.
    """
    first = heads.withColumn("kind", F.lit(0))
    then = rows.withColumn("kind", F.lit(1))
    both = first.unionByName(then, allowMissingColumns=True).repartition("conv")
    both = both.sortWithinPartitions("conv", "kind", F.asc_nulls_first("turn"), "name")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, skip, number, path, words = None, 0, 0, [ROOT], [0]
        out: list[tuple] = []

        def step(name: bytes, n: int) -> None:
            nonlocal number, path, words
            if len(path) > segment:
                out.append((conv, number, b"".join(path), words, False))
                number, path, words = number + 1, path[-1:], words[-1:]
            path.append(hashlib.blake2b(path[-1] + name, digest_size=SIZE).digest())
            words.append(n)

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:  # the next conversation begins
                    if conv is not None:
                        out.append((conv, number, b"".join(path), words, True))
                    conv, skip, number, path, words = row["conv"], row["h"], 0, [ROOT], [0]
                    for turn in row["head"] or ():
                        step(turn["name"], turn["words"])
                elif skip:
                    skip -= 1
                else:
                    step(row["name"], row["words"])
                if len(out) >= 1000 or out and len(out[-1][2]) > 1 << 18:
                    yield _batch(out, PATH)
                    out = []
        if conv is not None:
            out.append((conv, number, b"".join(path), words, True))
        yield _batch(out, PATH)

    return both.mapInArrow(walk, PATH)


KINDS = {
    "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(name, KINDS[kind]) for name, kind in (part.split() for part in schema.split(","))]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = _fields(schema)
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _ended(paths: DataFrame) -> DataFrame:
    """One row for each node where conversations end, with their number, the smallest and the digest.

    Ids are sorted over all tasks and joined to long texts there; one task then puts the texts of a node
    in order through SHA-256, without holding them.
    """
    last = paths.where("last").withColumn("end", F.substring("path", -SIZE, SIZE)).drop("last")
    tasks = max(1, _size(paths)[1] // TASK_TURNS)
    spread = last.repartitionByRange(tasks, "end", "conv").sortWithinPartitions("end", "conv")
    part = "end binary, segment int, path binary, words array<long>, low long, n long, ids string"

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, held, size = None, [], 0

        def flush() -> pa.RecordBatch:
            ids = [r["conv"] for r in held]
            one = held[0]
            row = (one["end"], one["segment"], one["path"], one["words"], ids[0], len(ids), ",".join(map(str, ids)))
            return _batch([row], part)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["end"] != end or size > ID_TEXT):
                    yield flush()
                    held, size = [], 0
                end, size = row["end"], size + len(str(row["conv"])) + 1
                held.append(row if not held else {"conv": row["conv"]})
        if held:
            yield flush()

    texts = spread.mapInArrow(_packed(join_ids, part), part)
    ordered = texts.repartition("end").sortWithinPartitions("end", "low")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, sha = None, 0, None

        def item() -> pa.RecordBatch:
            at = len(first["path"]) // SIZE - 1
            row = (first["segment"], first["path"], first["words"], [at], [n], [first["low"]], [0], [0], [0], [sha.hexdigest()])
            return _batch([row], f"segment int, {ITEM}")

        for batch in batches:
            for row in batch.to_pylist():
                if first is None or row["end"] != first["end"]:
                    if first is not None:
                        yield item()
                    first, n, sha = row, 0, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(row["ids"].encode())
                n += row["n"]
        if first is not None:
            yield item()

    return ordered.mapInArrow(_packed(digest, f"segment int, {ITEM}"), f"segment int, {ITEM}")


def _packed(make, schema: str):
    """The same rows in batches of about 4 MB instead of one batch a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for one in make(batches):
            held.append(one)
            size += one.nbytes
            if size > 4 << 20 or len(held) >= 5000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
        else:
            yield _batch([], schema)

    return run


def _size(items: DataFrame) -> tuple[int, int]:
    """(rows, nodes along their paths)."""
    row = items.agg(F.count("*"), F.sum(F.length("path"))).head()
    return row[0], (row[1] or 0) // SIZE


@dataclass
class _Node:
    """A node while its level is open to what is stripped from below."""

    item: int
    n: int = 0
    low: int | None = None
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    rows: list[list] = field(default_factory=list)  # children already complete

    def add(self, n: int, low: int | None, kids: int, leaves: int, saved: int) -> None:
        self.n += n
        self.kids += kids
        self.leaves += leaves
        self.saved += saved
        if low is not None:
            self.low = low if self.low is None else min(low, self.low)


def peel(
    items: list[dict], first_depth: int, alone: bool, merged: bool, segment: int = SEGMENT
) -> tuple[list[list], list[tuple]]:
    """(complete nodes, paths with the partial figures of the others) of a run of sorted paths.

    `first_depth` is the depth of the first node of every path. `alone` says that no other task
    holds these nodes, so all are complete; nodes of the first depth are handed on unless they are
    the root. `merged` says that the items were handed on by other tasks. A node is marked as
    shared if children of it may have been complete before it was.
    """
    levels: dict[int, list[tuple[int, int]]] = {}
    for i, item in enumerate(items):
        for slot, position in enumerate(item["at"]):
            levels.setdefault(position, []).append((i, slot))
    paths = [item["path"] for item in items]
    edges = () if alone else (min(paths), max(paths))
    done: list[list] = []
    combs: dict[int, list[tuple]] = {}
    on: dict[bytes, _Node] = {}
    for position in range(max(levels), -1, -1):
        lo, hi = position * SIZE, (position + 1) * SIZE
        for i, slot in levels.get(position, ()):  # conversations that newly end, or partial figures
            item = items[i]
            node = on.setdefault(paths[i][lo:hi], _Node(i))
            node.add(*(item[name][slot] for name in ("n", "low", "kids", "leaves", "saved")))
            node.ends = item["ends"][slot] or node.ends
        depth, above = first_depth + position, {}
        for name, node in on.items():  # the level is grouped: strip the last turn
            up = paths[node.item][lo - SIZE : lo] if position else None
            parent = above.setdefault(up, _Node(node.item)) if position else None
            if any(edge[lo:hi] == name for edge in edges) or (not position and first_depth):
                own = (position, node.n, node.low, node.kids, node.leaves, node.saved, node.ends)
                combs.setdefault(node.item, []).append(own)
                done += node.rows  # their parent is not known here
                continue
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * items[node.item]["words"][position]
            for row in node.rows:
                row[4] = node.low
            done += node.rows
            row = [
                name, up, node.low, depth, None, node.n, node.kids, node.leaves, node.saved,
                node.ends or NO_ENDS, merged or depth % segment == 0,
            ]
            if parent is None:
                done.append(row)
            else:
                parent.add(node.n, node.low, 1, node.leaves, node.saved)
                parent.rows.append(row)
        on = above
    handed = []
    for i, own in combs.items():
        own.sort()
        end = (own[-1][0] + 1) * SIZE
        handed.append((paths[i][:end], items[i]["words"][: own[-1][0] + 1], *map(list, zip(*own))))
    return done, handed


def _peeled(items: DataFrame, tasks: int, first_depth: int, merged: bool, segment: int) -> DataFrame:
    """One round: complete nodes and paths to be merged further, over `tasks` runs of sorted paths."""
    alone = tasks == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in batch.to_pylist()]
        done, handed = peel(held, first_depth, alone, merged, segment) if held else ([], [])
        for rows, schema, name in ((done, NODE, "node"), (handed, ITEM, "item")):
            other, blank = ("item", ITEM) if name == "node" else ("node", NODE)
            for at in range(0, len(rows), 10_000):
                made = _batch(rows[at : at + 10_000], schema)
                full = pa.StructArray.from_arrays(made.columns, names=made.schema.names)
                none = pa.nulls(len(made), pa.struct(_fields(blank)))
                columns = {name: full, other: none}
                yield pa.record_batch([columns["node"], columns["item"]], ["node", "item"])

    placed = items.repartition(1) if alone else items.repartitionByRange(tasks, "path")
    return stored(placed.mapInArrow(run, RESULT))


def prefix_trie(
    rows: DataFrame, heads: DataFrame, segment: int = SEGMENT, task_turns: int = TASK_TURNS, fan_in: int = FAN_IN
) -> DataFrame:
    """A row for each node, from the turns and heads that the functions above give.

    name (of the node), conv_id (smallest member), depth, parent_conv_id, n_convs (members),
    n_children, n_leaves, saved_tokens (over the subtree, words of the last turn for each member but
    one), ends_sha256 (ids of the members that end here).
    """
    paths = stored(_paths(rows, heads, segment))
    ended = stored(_ended(paths))
    deepest = paths.agg(F.max("segment")).head()[0]
    nodes, below = [], None
    for number in range(deepest if deepest is not None else -1, -1, -1):
        items = ended.where(F.col("segment") == number).drop("segment")
        if below is not None:  # the first nodes of the segment below end paths of this one
            inner = paths.where((F.col("segment") == number) & ~F.col("last"))
            inner = inner.withColumn("name", F.substring("path", -SIZE, SIZE)).groupBy("name")
            inner = inner.agg(F.first("path").alias("path"), F.first("words").alias("words"))
            ends = below.withColumnRenamed("path", "name").drop("words", "at").join(inner, "name")
            items = items.unionByName(ends.withColumn("at", F.array(F.size("words") - 1)).drop("name"))
        merged, first_depth = False, number * segment
        tasks = max(1, -(-_size(items)[1] // task_turns))
        while True:
            out = _peeled(items, tasks, first_depth, merged, segment)
            nodes.append(out.where("node IS NOT NULL").select("node.*"))
            items, merged = out.where("item IS NOT NULL").select("item.*"), True
            if tasks == 1:
                break
            tasks = -(-tasks // fan_in)
        below = items
    if not nodes:
        nodes = [rows.sparkSession.createDataFrame([], NODE)]
    found = nodes[0]
    for more in nodes[1:]:
        found = found.unionByName(more)
    return _with_parents(found).select(
        "name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def _with_parents(found: DataFrame) -> DataFrame:
    """Nodes whose parent was completed in a later round look it up; popular parents are copied to salts."""
    waiting = F.col("parent_conv_id").isNull() & (F.col("depth") > 0)
    salt = F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")
    late = found.where(waiting).drop("parent_conv_id").withColumn("salt", salt)
    parents = found.where("shared").select(
        F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    return found.where(~waiting).unionByName(late.join(parents, ["above", "salt"]).drop("salt"))
