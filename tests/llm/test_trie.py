"""The prefix trie of conversations against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from patronlens.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def content(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows, base=20):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, content(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    if not base:
        return own
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % base, [])[:h] + ts[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for node, own in members.items():
        below = [v for v in members if v[: len(node)] == node]
        inner = {v[:-1] for v in below if len(v) > len(node)}
        saved = sum((len(members[v]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", v[-1][1])) if v else 0) for v in below)
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(node))))
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else -1, len(own),
            sum(len(v) == len(node) + 1 for v in below), sum(v not in inner for v in below),
            saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out)


def got(frame):
    return sorted(tuple(-1 if v is None else v for v in row) for row in frame.select(COLUMNS).collect())


def build(spark, rows, base=20, **limits):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.selectExpr("*", "1 AS conv", "'x' AS name", "2 AS words", "cast(null as int) AS h", "3 AS kind")
    turns = trie.turns(table)
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return trie.prefix_trie(turns, trie.with_base_prefix(turns, base, taken, 3) if base else trie.no_prefix(turns), **limits)


def many(seed, convs=60, deepest=12, choices=2):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(["user", "assistant"]), "  ".join(["w"] * rng.randrange(choices)))
        for c in rng.sample(range(200), convs) for t in range(rng.choice([1, 2, 3, deepest]))
    ]


AWKWARD = [
    (0, 1, "user", "b"), (0, None, None, "a"), (0, 1, "user", "a"), (0, 1, "user", "a"),
    (20, None, None, None), (21, 0, "", ""), (33, 5, "user", " é x\ty"), (34, 5, "user", " é x\ty"),
    (None, 0, "user", "nobody's"), (45, 0, "u", "word " * 50_000), (46, 0, "u", "word " * 50_000),
    (7, 3, "a", "bc"), (8, 3, "ab", "c"),
]


@pytest.mark.parametrize("base", [20, None])
@pytest.mark.parametrize("limits", [{}, {"task_turns": 9, "fan_in": 2}, {"segment": 3}, {"segment": 4, "task_turns": 10, "fan_in": 3}])
def test_trie_matches_plain_prefixes(spark, base, limits):
    for rows in (many(1), AWKWARD, many(2, convs=40, choices=1)):
        assert got(build(spark, rows, base, **limits)) == plain_trie(rebuilt(rows, base))


def test_chain_of_snapshots_and_copies(spark):
    """Each conversation one turn longer than the one before, and a hundred equal ones."""
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 31) for t in range(c)]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 200) for t in range(12)]
    assert got(build(spark, rows, None, segment=8, task_turns=30)) == plain_trie(rebuilt(rows, None))


def test_ids_of_many_ends_are_joined_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_TEXT", 10)
    monkeypatch.setattr(trie, "TASK_TURNS", 40)
    rows = [(c, 0, "user", "hello") for c in range(95, 205)] + [(c, 1, "user", "again") for c in range(95, 105)]
    assert got(build(spark, rows, None)) == plain_trie(rebuilt(rows, None))


def test_no_rows_make_no_nodes(spark):
    assert got(build(spark, [])) == [] and got(build(spark, [(None, 0, "user", "x")])) == []


def test_one_popular_opening_is_dealt_over_tasks(spark):
    """Half of the conversations share their first turns; the runs of sorted paths stay even."""
    rows = [(c, t, "user", "hi" if c % 2 and t < 3 else f"{c} {t}") for c in range(400) for t in range(6)]
    turns = trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    ended = trie._ended(trie._paths(turns, trie.no_prefix(turns), trie.SEGMENT)).drop("segment")
    sizes = ended.repartitionByRange(8, "path").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 3 * 400 / 8
