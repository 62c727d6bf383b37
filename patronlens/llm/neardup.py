"""Near-duplicate texts: a chosen-path join of shingle sets.

Each document is represented by minwise values of its set. Several independent trees branch the
documents: a node picks one or two positions (1 / similarity on average) by hash of the node, and
a child holds the documents that agree in the value there. Which nodes a document passes follows
from its own values alone, so `step` levels are expanded at once without moving any text.

Texts with equal sets are one class from the start. In every round
  1. nodes of up to `small` classes compare all pairs by sketches (two bits of each of 256 minwise
     values), in passes: a class gives the pair with the one most alike to it in its node, then those with the
     4 most alike, then all that are left. After each pass the pairs are confirmed on the full sets, and
     classes of one label are not paired again, so a group of near copies is joined by
     about as many pairs as it has members. After the first pass a pair is given by one of the nodes it shares.
     What is left then are pairs that are nearly similar enough, as many as the square of a group's size: these
     are told apart where they lie, by sketches of 2,048 values and then by their whole sets, and a node
     gives no more than the links that tie its classes together;
  2. larger nodes, of which there are few, are compared with a few classes of their own, which joins
     large groups of near copies by a number of pairs that is linear in them;
  3. what is not one group then branches further, each node with several independent trees of its own, as
     pairs die out on the way down a single one. At the last level nodes are compared in blocks.
Members of large nodes meet their few nodes where they are, so a crowded node never fills a task. Components
are found once, at the end.

The numbers of trees are set so that two sets at exactly the threshold (0.8) share a node with a
probability of more than 0.999 at every level, down to the last (`recall` gives it). Further
levels only happen in crowded nodes.

Defined results: a text without words, or null, has an empty set and links with nothing, and
neither does a row with null id; both are kept. Ids may be of any type that can be ordered. Rows that
share an id are one vertex for components. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patronlens.llm.common import stored
from patronlens.llm.graph import connected_components, in_blocks, runs
from patronlens.llm.shingles import MinHash, fingerprint, mixed, shingle_sets
from patronlens.operators.joins import join_unique

WORDS = 5
PERCENT = 80
TREES = 12
STEP = 3
ROUNDS = 5
SMALL = 1 << 14
#: Pairs at the threshold should share a node of the last level at least this often.
RECALL = 0.999
#: Classes of a node that all its others are compared with first.
PIVOTS = 3
#: Rounds in which linked classes take over the least label, and the label of that one, before each pass.
LABEL_ROUNDS = 3
#: Pairs that a class gives in each pass over its node; the last takes all that a small node can have.
WIDTHS = (1, 4, SMALL)
#: Rows of a node that are compared with all others at a time.
CHUNK = 256
POSITIONS = 64
SKETCHED, FINE = 256, 2048
#: Passes over a node after which its members get the finer sketches, and their sets.
FINE_AFTER = 2
#: Shingles of a set that its class takes along, at most; pairs with a larger one are confirmed elsewhere.
TAKEN = 1024
#: Nodes of a class by which it is known where else a pair meets; pairs that share none of them are repeated.
KNOWN_NODES = 32
SEED = 97
#: Ids of candidates, and large nodes, are broadcast up to this number; beyond it rows are shuffled to them.
BROADCAST_IDS = 2_000_000
BROADCAST_NODES = 100_000
#: Documents, and bytes of text, whose sets are made at once; a single longer text is taken whole.
GROUP, GROUP_BYTES = 512, 8 << 20


def _pieces(whole: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded size."""
    sizes = pc.fill_null(pc.binary_length(whole.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    first = 0
    while first < whole.num_rows:
        limit = (ends[first - 1] if first else 0) + GROUP_BYTES
        count = min(GROUP, max(1, int(np.searchsorted(ends, limit, "right")) - first))
        yield whole.slice(first, count)
        first += count


def _sketch(values: np.ndarray) -> list[bytes]:
    """Two bits of each minwise value: the lower ones of all positions, then the higher ones."""
    bits = [np.packbits((values & np.uint32(bit)).astype(bool), axis=1) for bit in (1, 2)]
    return [row.tobytes() for row in np.concatenate(bits, axis=1)]


def _signatures(words: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size, fingerprint, minwise values and sketch of each document's set."""
        minhash = MinHash(SKETCHED, SEED)
        for whole in batches:
            for batch in _pieces(whole, "text"):
                sets = shingle_sets(batch.column("text").to_pylist(), words)
                prints = [fingerprint(s) for s in sets]
                values = minhash(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                     pa.array([v.tobytes() for v in values[:, :POSITIONS]], pa.binary()),
                     pa.array(_sketch(values), pa.binary())],
                    names=["id", "n", "print_a", "print_b", "signature", "sketch"],
                )

    return signed


def _key(shingles: np.ndarray) -> str:
    """What names a class: fingerprint and size of its set."""
    return "%d %d " % fingerprint(shingles) + str(len(shingles))


def with_print(docs: DataFrame, name: str, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs with the fingerprint of each text's set of shingles."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, text_col):
                sets = shingle_sets(batch.column(text_col).to_pylist(), words)
                prints = pa.array(["%d %d" % fingerprint(s) for s in sets], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, name])

    return docs.mapInArrow(printed, StructType([*docs.schema.fields]).add(name, "string"))


def recall(percent: int, trees: int, again: int, rounds: int) -> float:
    """How often a pair at the threshold shares a node after so many rounds of STEP levels.

    The two agree in a binomial number of their minwise values. Given that number, the nodes they
    share are a branching process, whose extinction is computed from the last level up.
    """
    often, found = min(1.0, 100 / percent - 1), 0.0
    for agreeing in range(POSITIONS + 1):
        one = agreeing / POSITIONS
        both = one * (agreeing - 1) / (POSITIONS - 1)
        lost = 0.0
        for round_no in range(rounds):
            lost = lost**again if round_no else lost
            for _ in range(STEP):
                two = (1 - 2 * one + both) + 2 * (one - both) * lost + both * lost**2
                lost = (1 - often) * (1 - one + one * lost) + often * two
        chance = comb(POSITIONS, agreeing) * (percent / 100) ** agreeing * (1 - percent / 100) ** (POSITIONS - agreeing)
        found += chance * (1 - lost**trees)
    return found


def trees_again(percent: int, trees: int, rounds: int = ROUNDS) -> int:
    """Trees that a crowded node needs for RECALL at the last level; as many as at the start at most."""
    return next((k for k in range(1, trees) if recall(percent, trees, k, rounds) >= RECALL), trees)


def _expand(step: int, trees: int, percent: int):
    """Rows of (node or none, rep, n, signature, sketch) to the nodes `step` levels further down.

    `trees` trees begin at each node, or at the common root if there is none.
    """

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.uint64(min((1 << 32) - 1, int((100 / percent - 1) * (1 << 32))))
        roots = mixed(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32)
                signature = signature.reshape(-1, POSITIONS)
                if "node" in batch.schema.names:
                    above = batch.column("node").to_numpy().view(np.uint64)
                else:
                    above = np.zeros(batch.num_rows, np.uint64)
                row = np.repeat(np.arange(batch.num_rows), trees)
                node = np.tile(roots, batch.num_rows) ^ above[row]
                with np.errstate(over="ignore"):
                    for _ in range(step):
                        choice = mixed(node ^ np.uint64(0xD1B54A32D192ED03))
                        one = (choice % np.uint64(POSITIONS)).astype(np.int64)
                        skip = ((choice >> np.uint64(8)) % np.uint64(POSITIONS - 1)).astype(np.int64)
                        two = (one + 1 + skip) % POSITIONS
                        more = (choice >> np.uint64(32)) < often
                        node, row, at = (
                            np.concatenate([node, node[more]]), np.concatenate([row, row[more]]),
                            np.concatenate([one, two[more]]),
                        )
                        token = signature[row, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32))
                        node = mixed(node * np.uint64(3) + mixed(token + np.uint64(1)))
                kept = [c for c in ("rep", "n", "sketch") if c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), *[batch.column(c).take(pa.array(row)) for c in kept]],
                    names=["node", *kept],
                )

    return expanded


def least_agreement(percent: int, positions: int) -> int:
    """Positions whose two bits agree, at least, for a pair at the threshold: five deviations off."""
    p = percent / 100 + (1 - percent / 100) / 4
    return int(positions * p - 5 * np.sqrt(positions * p * (1 - p)))


class _Sketches:
    """Members of a node: which pairs of them can be links, by size and sketch."""

    def __init__(self, n: np.ndarray, sketch: list[bytes], percent: int) -> None:
        self.n, self.percent = n, percent
        words = np.frombuffer(b"".join(sketch), np.uint64).reshape(len(n), -1)
        half = words.shape[1] // 2
        self.low, self.high, self.positions = words[:, :half], words[:, half:], 64 * half
        self.weak = POSITIONS - least_agreement(percent, POSITIONS)
        self.strong = self.positions - least_agreement(percent, self.positions)

    def fit(self, rows: slice, others: slice) -> np.ndarray:
        """By the first 64 positions, rows x others."""
        unlike = self.low[rows, 0][:, None] ^ self.low[others, 0]
        unlike |= self.high[rows, 0][:, None] ^ self.high[others, 0]
        return np.bitwise_count(unlike) <= self.weak

    def unlike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many positions pairs differ; all where sizes forbid the similarity."""
        a, b = self.n[i], self.n[j]
        total = np.full(len(i), self.positions, np.uint16)
        ok = 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)
        i, j = i[ok], j[ok]
        found = np.zeros(len(i), np.uint16)
        for k in range(self.low.shape[1]):
            found += np.bitwise_count((self.low[i, k] ^ self.low[j, k]) | (self.high[i, k] ^ self.high[j, k]))
        total[ok] = found
        return total


def candidates(
    sketches: _Sketches, label: np.ndarray, apart: np.ndarray | None = None, width: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs (i, j) of a node's members, j < i, to be confirmed, and whether more are left.

    Pairs of one label are known to be together. `apart` holds blocks; if given, only pairs of
    different blocks count, as the others meet elsewhere. Each i gives the `width` pairs that are
    most alike.
    """
    m = len(label)
    for start in range(0, m, CHUNK):
        end = min(start + CHUNK, m)
        ok = sketches.fit(slice(start, end), slice(0, end))
        ok &= np.arange(end) < np.arange(start, end)[:, None]
        ok &= label[start:end, None] != label[:end]
        if apart is not None:
            ok &= apart[start:end, None] != apart[:end]
        i, j = np.nonzero(ok)
        i += start
        unlike = sketches.unlike(i, j)
        alike = unlike <= sketches.strong
        i, j, unlike = i[alike], j[alike], unlike[alike]
        if width is None:
            yield i, j, False
            continue
        order = np.lexsort((unlike, i))
        i, j = i[order], j[order]
        near = np.arange(len(i)) - np.searchsorted(i, i) < width
        yield i[near], j[near], not near.all()


def meets_first(nodes: list[list[int]], node: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs (i, j) of a node's members share no smaller node; `nodes` are those known of each."""
    smaller = [[x for x in own if x < node] for own in nodes]
    longest = max(map(len, smaller), default=0)
    table = np.full((longest, len(nodes)), node, np.int64)  # of one member at least, a place without a node
    for at, own in enumerate(smaller):
        table[: len(own), at] = own
    first = np.ones(len(i), bool)
    for start in range(0, len(i), 1 << 16):
        part = slice(start, start + (1 << 16))
        of_i, of_j = table[:, i[part]], table[:, j[part]]
        for x in of_i:
            real = x != node
            for y in of_j:
                first[part] &= (x != y) | ~real
    return first


def links_between(
    sets: list[np.ndarray | None], label: np.ndarray, percent: int, i: np.ndarray, j: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those that tie two labels together, and those with a set that is not at hand.

    Pairs are compared on their sets. Tied labels become one in `label`, so that further pairs of theirs
    are not compared.
    """
    known = np.array([s is not None for s in sets])
    here = known[i] & known[j]
    kept = [(i[~here], j[~here])]
    i, j = i[here], j[here]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
    for first, end in zip(starts, [*starts[1:], len(i)]):
        one = i[first]
        own = sets[one]
        for begin in range(first, end, CHUNK):
            others = j[begin : min(begin + CHUNK, end)]
            others = others[label[others] != label[one]]
            if not len(others):
                continue
            values = np.concatenate([sets[k] for k in others])
            sizes = np.array([len(sets[k]) for k in others])
            at = np.minimum(np.searchsorted(own, values), len(own) - 1)
            common = np.add.reduceat(own[at] == values, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
            for k in others[100 * common >= percent * (len(own) + sizes - common)]:
                if label[k] != label[one]:
                    label[label == label[k]] = label[one]
                    kept.append((np.array([one]), np.array([k])))
    return np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept])


def _pairs(percent: int, width: int | None):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates (a, b, node) of members (node, rep, n, sketch, label, own, block_a, block_b).

        A row without a and b names a node that has more. If members have `nodes`, a pair is given only
        where it meets first; if they have `shingles`, only links between labels are given.
        """
        for table, groups in runs(batches, ["node", "block_a", "block_b"]):
            for first, end in groups:
                if end - first < 2:
                    continue
                rows = table.slice(first, end - first)
                label = rows["label"].to_numpy()
                if (label == label[0]).all():
                    continue
                rep, node = rows["rep"].to_numpy(), rows["node"][0].as_py()
                order = np.argsort(mixed(rep.view(np.uint64)))  # the same in all nodes
                rows, rep, label = rows.take(pa.array(order)), rep[order], label[order]
                several = rows["block_a"][0] != rows["block_b"][0]
                sketches = _Sketches(rows["n"].to_numpy(), rows["sketch"].to_pylist(), percent)
                nodes = rows["nodes"].to_pylist() if "nodes" in rows.column_names else None
                sets = None
                if "shingles" in rows.column_names:
                    sets = [None if x is None else np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
                more = False
                for i, j, left in candidates(sketches, label, rows["own"].to_numpy() if several else None, width):
                    more = more or left
                    if nodes is not None:
                        first_here = meets_first(nodes, node, i, j)
                        i, j = i[first_here], j[first_here]
                    if sets is not None:
                        i, j = links_between(sets, label, percent, i, j)
                    if len(i):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j])),
                             pa.array(np.full(len(i), node))],
                            names=["a", "b", "node"],
                        )
                if more:
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([node])], names=["a", "b", "node"]
                    )

    return compared


def _with_pivots(percent: int):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a member (rep, n, sketch) and a pivot (first, first_n, first_sketch) that can be links."""
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate([batch.column(c).to_numpy() for c in ("n", "first_n")])
            sketches = _Sketches(n, batch.column("sketch").to_pylist() + batch.column("first_sketch").to_pylist(), percent)
            ok = sketches.unlike(np.arange(m), np.arange(m, 2 * m)) <= sketches.strong
            a, b = (batch.column(c).to_numpy()[ok] for c in ("rep", "first"))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return compared


_MEMBERS = "node long, rep long, n long, sketch binary"
_FOUND = "a long, b long, node long"


class _Join:
    """One run: the texts, their classes, and the links confirmed so far."""

    def __init__(self, texts: DataFrame, classes: DataFrame, words: int, percent: int) -> None:
        self.texts, self.classes, self.words, self.percent = texts, classes, words, percent
        self.links: list[DataFrame] = []

    def confirm(self, pairs: DataFrame) -> None:
        """Keeps the pairs that hold on the full sets as links."""
        pairs = stored(pairs.select("a", "b").distinct())
        ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()

        def lists(sets: list[np.ndarray]) -> list[pa.Array]:
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            values = np.concatenate([s.view(np.int64) for s in sets] or [np.empty(0, np.int64)])
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]

        sets = self._of_classes(ends, lists, "shingles array<long>")
        if sets is None:
            return
        with_b = pairs.join(sets, F.col("b") == F.col("of")).select("a", "b", F.col("shingles").alias("set_b"))
        both = with_b.join(sets, F.col("a") == F.col("of")).select("a", "b", "set_b", F.col("shingles").alias("set_a"))
        common = F.size(F.array_intersect("set_a", "set_b"))
        held = both.select("a", "b", common.alias("c"), (F.size("set_a") + F.size("set_b")).alias("total")).where(
            100 * F.col("c") >= self.percent * (F.col("total") - F.col("c"))
        )
        self.links.append(stored(held.select("a", "b")))

    def _of_classes(self, ends: DataFrame, make, columns: str) -> DataFrame | None:
        """(of, columns) for the classes in `ends`, made from the sets of their texts; None for no classes."""
        known = self.classes.select("least", F.col("rep").alias("a"), "key")
        wanted = stored(known.join(ends, "a").select("least", F.col("a").alias("of"), "key"))
        count = wanted.count()
        if not count:
            return None
        wanted = F.broadcast(wanted) if count <= BROADCAST_IDS else wanted
        texts = self.texts.join(wanted, F.col("id") == F.col("least")).select("of", "key", "text")
        words, names = self.words, [c.split()[0] for c in columns.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in _pieces(whole, "text"):
                    sets = shingle_sets(batch.column("text").to_pylist(), words)
                    # An id may have several texts; a class is asked for that of its own set.
                    own = [at for at, s in enumerate(sets) if _key(s) == batch.column("key")[at].as_py()]
                    of = batch.column("of").take(pa.array(own, pa.int64()))
                    yield pa.RecordBatch.from_arrays([of, *make([sets[at] for at in own])], names=["of", *names])

        made = texts.mapInArrow(run, f"of long, {columns}")
        # Repeated rows of an id give its set once.
        return stored(made.groupBy("of").agg(*[F.any_value(name).alias(name) for name in names]))

    def finer(self, members: DataFrame) -> DataFrame:
        """members with sketches of more positions and the sets that are not too large, which tell apart
        what is nearly similar enough."""
        minhash = MinHash(FINE, SEED)

        def made_of(sets: list[np.ndarray]) -> list[pa.Array]:
            taken = [s.tobytes() if len(s) <= TAKEN else None for s in sets]
            return [pa.array(_sketch(minhash(sets)), pa.binary()), pa.array(taken, pa.binary())]

        made = self._of_classes(members.select(F.col("rep").alias("a")).distinct(), made_of, "fine binary, shingles binary")
        kept = [c for c in members.columns if c != "sketch"]
        joined = members.join(made.withColumnRenamed("of", "rep"), "rep")
        return joined.select(*kept, F.col("fine").alias("sketch"), "shingles")

    def labelled(self, members: DataFrame) -> DataFrame:
        """members with a label that linked ones share, the least class that a few rounds of taking over the
        least label of their links have brought; classes that are far apart may keep different ones."""
        if not self.links:
            return members.withColumn("label", F.col("rep"))
        links = reduce(DataFrame.unionByName, self.links)
        each = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        both = stored(links.select(each.alias("x")).select("x.*").distinct())
        known = both.groupBy(F.col("a").alias("of")).agg(F.least("of", F.min("b")).alias("found"))
        for _ in range(LABEL_ROUNDS):
            near = both.join(known.withColumnRenamed("of", "b"), "b").groupBy(F.col("a").alias("of"))
            near = near.agg(F.min("found").alias("near"))
            beyond = known.select(F.col("of").alias("near"), F.col("found").alias("far"))
            known = stored(near.join(beyond, "near").select("of", F.least("near", "far").alias("found")))
        joined = members.join(known.withColumnRenamed("of", "rep"), "rep", "left")
        return joined.withColumn("label", F.coalesce("found", "rep")).drop("found")

    def compare(self, members: DataFrame, width: int | None) -> DataFrame:
        """Candidates of members with label, own and blocks, which lie side by side."""
        return stored(members.mapInArrow(_pairs(self.percent, width), _FOUND))


def _with_nodes(members: DataFrame) -> DataFrame:
    """members with the first of their nodes, in order."""
    nodes = F.slice(F.array_sort(F.collect_list("node")), 1, KNOWN_NODES).alias("nodes")
    return members.join(members.groupBy("rep").agg(nodes), "rep")


def _side_by_side(members: DataFrame) -> DataFrame:
    """Each node as one block."""
    one = members.withColumns({c: F.lit(0) for c in ("own", "block_a", "block_b")})
    return one.repartition("node").sortWithinPartitions("node")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    trees: int = TREES,
) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType().add("id", docs.schema[id_col].dataType)
    for name in ("n", "print_a", "print_b"):
        schema.add(name, "long")
    schema.add("signature", "binary").add("sketch", "binary")
    rows = stored(texts.mapInArrow(_signatures(words), schema))
    has_set = F.col("id").isNotNull() & (F.col("n") > 0)
    key = F.concat_ws(" ", "print_a", "print_b", "n").alias("key")
    usable = rows.where(has_set).select("id", "n", key)
    # The set of a class is that of its members; classes are numbered, whatever the type of ids.
    grouped = rows.where(has_set).groupBy("print_a", "print_b", "n").agg(
        F.min("id").alias("least"), F.any_value("signature").alias("signature"), F.any_value("sketch").alias("sketch")
    )
    classes = stored(grouped.select(key, "n", "least", "signature", "sketch", F.monotonically_increasing_id().alias("rep")))
    # An id with several texts ties their classes together.
    several = usable.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    reps = classes.select("rep", "n", "signature", "sketch")
    join = _Join(texts.where(F.col("id").isNotNull()), classes, words, percent)
    frontier = reps.mapInArrow(_expand(STEP, trees, percent), _MEMBERS)
    again = trees_again(percent, trees)
    for round_no in range(ROUNDS):
        last = round_no == ROUNDS - 1
        large = stored(frontier.groupBy("node").count().where(F.col("count") > SMALL).select("node"))
        n_large = large.count()
        crowded = F.broadcast(large) if n_large <= BROADCAST_NODES else large
        small = frontier.join(crowded, "node", "left_anti") if n_large else frontier
        members = stored(frontier.join(crowded, "node")) if n_large else None
        unfinished = small
        for at, width in enumerate(WIDTHS):
            found = join.compare(_side_by_side(join.labelled(unfinished)), width)
            pairs = found.where("a IS NOT NULL").select("a", "b")
            if n_large and not at:
                pairs = pairs.unionByName(_pivot_pairs(members, percent))
            join.confirm(pairs)
            nodes = stored(found.where("a IS NULL").select("node").distinct())
            n_nodes = nodes.count()
            if not n_nodes:
                break
            known = F.broadcast(nodes) if n_nodes <= BROADCAST_NODES else nodes
            unfinished = _with_nodes(stored(unfinished.drop("nodes").join(known, "node", "left_semi")))
            if at + 1 == FINE_AFTER:
                unfinished = join.finer(unfinished)
            unfinished = stored(unfinished)
        if not n_large:
            break
        members = join.labelled(members)
        nodes = members.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        nodes = stored(nodes.where("low < high").select("node"))
        if nodes.isEmpty():
            break
        members = members.join(F.broadcast(nodes) if n_large <= BROADCAST_NODES else nodes, "node", "left_semi")
        if last:
            join.confirm(join.compare(in_blocks(join.finer(members), "node", "rep", SMALL), None))
        else:
            deeper = members.drop("label").join(reps.select("rep", "signature"), "rep")
            frontier = deeper.select("node", "rep", "n", "signature", "sketch").mapInArrow(_expand(STEP, again, percent), _MEMBERS)
    first = usable.join(several, "id").select("id", "key").distinct().join(classes.select("key", "rep"), "key")
    low = first.groupBy("id").agg(F.min("rep").alias("b"))
    ties = first.join(low, "id").select(F.col("rep").alias("a"), "b")
    links = reduce(DataFrame.unionByName, [ties, *join.links])
    found = classes.join(connected_components(links), F.col("rep") == F.col("node"), "left").select(
        "key", "least", F.coalesce("component", "rep").alias("group")
    )
    smallest = found.groupBy("group").agg(F.min("least").alias("component_id"))
    of_class = found.join(smallest, "group").select("key", "component_id")
    placed = join_unique(of_class, usable, "key", "inner").select("id", "n", "component_id")
    alone = rows.where(~F.coalesce(has_set, F.lit(False))).select("id", "n", F.col("id").alias("component_id"))
    return placed.unionByName(alone).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of large nodes and a few classes of these; the order by hash is the same in
    all nodes, so nodes share their pivots."""
    nodes = members.groupBy("node").agg(*[
        F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("order"), "rep", "n", "sketch")).alias(f"p{k}")
        for k in range(PIVOTS)
    ])
    pivots = nodes.select("node", F.explode(F.array_distinct(F.array(*[
        F.struct(*[F.col(f"p{k}.{c}").alias(c) for c in ("rep", "n", "sketch")]) for k in range(PIVOTS)
    ]))).alias("p"))
    pivots = stored(pivots.select(
        "node", F.col("p.rep").alias("first"), F.col("p.n").alias("first_n"), F.col("p.sketch").alias("first_sketch")
    ))
    known = F.broadcast(pivots) if pivots.count() <= PIVOTS * BROADCAST_NODES else pivots
    tried = members.join(known, "node").where("rep != first").drop("node")
    return tried.mapInArrow(_with_pivots(percent), "a long, b long")
