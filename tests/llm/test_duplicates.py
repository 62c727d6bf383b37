import random

import numpy as np
import pyarrow as pa
import pytest

from edge import TEXTS, components, documents
from patronlens.llm import graph, neardup, vectors
from patronlens.llm.shingles import MinHash, shingle_sets


def plain_set(text, words):
    w = (text or "").encode().lower().split()
    if len(w) >= words:
        return frozenset(zip(*[w[k:] for k in range(words)]))
    return frozenset([tuple(w)]) if w else frozenset()


def plain_groups(rows, words):
    """{id: component} by comparing every two texts."""
    sets = [(i, plain_set(t, words)) for i, t in rows if i is not None]
    links = []
    for x, (a, s) in enumerate(sets):
        for b, t in sets[:x]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                links.append((a, b))
    return components(links, {i for i, _ in sets})


def noisy(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**9)}"
    return " ".join(words)


def test_shingle_sets_have_the_right_sizes_and_overlaps():
    texts = ["a b c a b", "A B\tC\na b", "a", "b a", "", None, "é É e", "x" * 3_000_000 + " y"]
    sets = shingle_sets(texts, 2)
    assert [len(s) for s in sets] == [len(plain_set(t, 2)) for t in texts]
    assert (sets[0] == sets[1]).all()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain_set(a, 2) & plain_set(b, 2))


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3600], rng.integers(0, 1 << 63, 400).astype(np.uint64)])
    x, y = MinHash(256, 1)([np.unique(a), np.unique(b)])
    assert abs((x == y).mean() - 3600 / 4400) < 0.08


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_match_all_pairs(spark, words):
    rng = random.Random(words)
    rows = list(TEXTS)
    for group in range(40):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 40, 200]))]
        for copy in range(rng.randrange(1, 6)):
            rows.append((100 + 10 * group + copy, noisy(rng, base, rng.choice([0, 0, 1, 3, 10]))))
    found = neardup.near_duplicates(documents(spark, rows, "rep node"), words=words).collect()
    wanted = plain_groups(rows, words)
    assert len(found) == len(rows)
    for row in found:
        if row.doc_id is not None:
            assert row.component_id == wanted[row.doc_id], row
            assert row.kept == (row.doc_id == row.component_id)
        else:
            assert row.component_id is None and row.kept
    sizes = sorted((r.doc_id or 0, r.n_shingles) for r in found)
    assert sizes == sorted((i or 0, len(plain_set(t, words))) for i, t in rows)


def test_crowded_nodes_branch_and_lose_nothing(spark, monkeypatch):
    """A large group of near copies among documents that share a long passage."""
    monkeypatch.setattr(neardup, "SMALL", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, noisy(rng, base, 2)) for i in range(150)]
    rows += [(1000 + i, " ".join(shared + [f"o{rng.randrange(10**6)}" for _ in range(50)])) for i in range(60)]
    rows += [(2000 + i, noisy(rng, base, 9)) for i in range(40)]
    found = neardup.near_duplicates(documents(spark, rows), words=2).collect()
    assert {r.doc_id: r.component_id for r in found} == plain_groups(rows, 2)


def shared_by_level(signatures, pairs, rounds):
    """Share of the pairs (2k, 2k + 1) that are together in some node after each round, if all nodes branch on."""
    again = getattr(neardup, "trees_again", lambda percent, trees: trees)(80, neardup.TREES)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(2 * pairs)), pa.array([9] * (2 * pairs)), pa.array([s.tobytes() for s in signatures])],
        names=["rep", "n", "signature"],
    )
    shares = []
    for round_no in range(rounds):
        expand = neardup._expand(neardup.STEP, again if round_no else neardup.TREES, 80)
        found = pa.Table.from_batches(expand([rows])).select(["node", "rep"]).to_pandas().drop_duplicates()
        found = found[found.duplicated("node", keep=False)]  # alone in a node: nothing more to find
        shares.append(found["rep"].nunique() / (2 * pairs))
        rows = pa.RecordBatch.from_arrays(
            [pa.array(found["node"].to_numpy()), pa.array(found["rep"].to_numpy()), pa.array([9] * len(found)),
             pa.array([signatures[i].tobytes() for i in found["rep"]])],
            names=["node", "rep", "n", "signature"],
        )
    return shares


def test_pairs_at_the_threshold_stay_together_to_the_last_level():
    pairs = 500
    rng = np.random.default_rng(4)
    signatures = rng.integers(0, 1 << 32, (2 * pairs, neardup.POSITIONS)).astype(np.uint32)
    signatures[1::2] = np.where(rng.random((pairs, neardup.POSITIONS)) < 0.8, signatures[::2], signatures[1::2])
    shares = shared_by_level(signatures, pairs, neardup.ROUNDS)
    assert min(shares) > 0.99, shares
    assert neardup.recall(80, neardup.TREES, neardup.trees_again(80, neardup.TREES), neardup.ROUNDS) >= 0.999
    # One tree a crowded node would lose them.
    assert neardup.recall(80, neardup.TREES, 1, neardup.ROUNDS) < 0.94


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_other_types(spark, kind):
    rng = random.Random(2)
    bases = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(12)]
    rows = [(i, noisy(rng, bases[i % 12], rng.choice([0, 1, 9]))) for i in range(60)] + [(3, None), (None, "x y z")]
    docs = documents(spark, rows)
    found = neardup.near_duplicates(docs.withColumn("doc_id", docs.doc_id.cast(kind)), words=2).collect()
    together = {}
    for r in found:
        if r.n_shingles and r.doc_id is not None:
            together.setdefault(r.component_id, set()).add(int(r.doc_id))
    wanted = {}
    for i, low in plain_groups(rows, 2).items():
        wanted.setdefault(low, set()).add(i)
    assert sorted(map(sorted, together.values())) == sorted(map(sorted, wanted.values()))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)


def node_of(rng, groups, alone, changes):
    """Sketches of groups of near copies and of members alike to nobody, with the true links."""
    values = []
    for size in groups:
        base = rng.integers(0, 1 << 32, neardup.SKETCHED)
        for _ in range(size):
            values.append(np.where(rng.random(neardup.SKETCHED) < changes, rng.integers(0, 1 << 32, neardup.SKETCHED), base))
    values += list(rng.integers(0, 1 << 32, (alone, neardup.SKETCHED)))
    values = np.array(values, np.uint32)[rng.permutation(len(values))]
    bits = [np.packbits((values & np.uint32(bit)).astype(bool), axis=1) for bit in (1, 2)]
    return values, [v.tobytes() for v in np.concatenate(bits, axis=1)]


def test_candidates_of_a_node_hold_its_links_pass_by_pass():
    rng = np.random.default_rng(3)
    values, sketch = node_of(rng, [150, 75, 2, 2], 75, 0.02)
    sketches = neardup._Sketches(np.full(len(values), 100), sketch, 80)
    m = len(values)
    full = {(i, j) for i in range(m) for j in range(i) if (values[i] == values[j]).mean() > 0.8}
    label, held, given = np.arange(m), set(), []
    for width in neardup.WIDTHS:
        found, more = [], False
        for i, j, left in neardup.candidates(sketches, label, None, width):
            found += zip(i.tolist(), j.tolist())
            more = more or left
        assert len(found) == len(set(found)) <= m * width and all(j < i and label[i] != label[j] for i, j in found)
        given.append(len(found))
        held |= full & set(found)
        together = components(held, range(m))
        label = np.array([together[i] for i in range(m)])
        if not more:
            break
    assert components(held, range(m)) == components(full, range(m))
    assert not more and sum(given) < 3 * m
    every = [pair for i, j, _ in neardup.candidates(sketches, np.arange(m)) for pair in zip(i.tolist(), j.tolist())]
    assert full <= set(every) and len(every) == len(set(every))


def test_a_group_just_below_the_threshold_gives_no_square_of_candidates(spark, monkeypatch):
    """Every two texts are alike at 0.786, in all the nodes they share."""
    made = {}
    compare = neardup._Join.compare

    def counted(self, members, width):
        found = compare(self, members, width)
        made[width] = [(r.a, r.b) for r in found.where("a IS NOT NULL").collect()]
        return found

    monkeypatch.setattr(neardup._Join, "compare", counted)
    shared = [f"s{k}" for k in range(89)]
    rows = [(i, " ".join(shared + [f"o{i}x{k}" for k in range(12)])) for i in range(60)]
    rows += [(100 + i, " ".join([f"p{k}" for k in range(60)] + [f"q{i}"])) for i in range(3)]
    found = neardup.near_duplicates(documents(spark, rows), words=2).collect()
    assert {r.doc_id: r.component_id for r in found} == plain_groups(rows, 2)
    one, few, rest = (made.get(width, []) for width in neardup.WIDTHS)
    assert len(few) == len(set(few)) and not rest
    assert len(set(one) | set(few)) < 60 * 59 // 2


def test_pairs_meet_first_in_one_of_their_nodes():
    rng = np.random.default_rng(8)
    member_of = [sorted(rng.choice(40, 9, replace=False).tolist()) for _ in range(30)]
    known = [own[:5] for own in member_of]
    given = {}
    for node in range(40):
        here = [i for i in range(30) if node in member_of[i]]
        i, j = np.tril_indices(len(here), -1)
        ok = neardup.meets_first([known[h] for h in here], node, i, j)
        for x, y in zip(i[ok], j[ok]):
            given.setdefault((here[x], here[y]), []).append(node)
    for x in range(30):
        for y in range(x):
            both = set(member_of[x]) & set(member_of[y])
            first = set(known[x]) & set(known[y])
            wanted = [min(first)] if first and min(first) == min(both) else None
            assert ((x, y) in given) == bool(both)
            assert wanted is None or given[x, y] == wanted


def test_links_between_labels_hold_all_groups_with_few_pairs():
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 1 << 62, 50).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.r_[base[k % 4][: 50 - k % 3], rng.integers(0, 1 << 62, 1 + k % 5).astype(np.uint64)]) for k in range(40)]
    i, j = (np.array(x) for x in zip(*[(x, y) for x in range(40) for y in range(x)]))
    links = [
        (x, y) for x, y in zip(i.tolist(), j.tolist())
        if 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))
    ]
    a, b = neardup.links_between(sets, np.arange(40), 80, i, j)
    few = list(zip(a.tolist(), b.tolist()))
    assert set(few) <= set(links) and len(few) < 40 < len(links)
    assert components(few, range(40)) == components(links, range(40))
    some = [None if k == 7 else s for k, s in enumerate(sets)]
    a, b = neardup.links_between(some, np.arange(40), 80, i, j)
    assert sum(7 in pair for pair in zip(a.tolist(), b.tolist())) == 39  # left to the confirmation


def test_no_documents(spark):
    assert neardup.near_duplicates(documents(spark, [])).collect() == []


def test_rows_that_share_an_id_tie_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(7, a), (7, b), (3, a), (9, b)]
    found = neardup.near_duplicates(documents(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(7, 3), (3, 3), (9, 3)}


def test_connected_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(501, 600)] + [(900, 901), (901, 900), (5, 5)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in graph.connected_components(frame).collect()}
    wanted = components(edges, {x for e in edges for x in e})
    assert found == wanted


def test_blocks_let_every_two_rows_meet_once(spark):
    members = spark.range(100).selectExpr("1L AS key", "id AS item").unionByName(
        spark.range(3).selectExpr("2L AS key", "id AS item")
    )
    rows = graph.in_blocks(members, "key", "item", 30).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.key, r.block_a, r.block_b), []).append((r.item, r.own))
    pairs = []
    for (key, a, b), items in groups.items():
        assert len(items) <= 70
        for i, own_i in items:
            pairs += [(key, i, j) for j, own_j in items if i < j and (a == b or own_i != own_j)]
    assert len(pairs) == len(set(pairs)) == 100 * 99 // 2 + 3


def plain_links(rows, cosine=0.95):
    usable = {}
    for at, (i, v) in enumerate(rows):
        if v and None not in v and i is not None:
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all() and x.any():
                usable[at] = x / np.abs(x).max()
    links = []
    for a in usable:
        for b in usable:
            if a < b and len(usable[a]) == len(usable[b]):
                x, y = usable[a], usable[b]
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links.append((a, b))
    return links


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for group in range(30):
        base = rng.normal(size=16)
        for copy in range(int(rng.integers(1, 8))):
            v = base + rng.normal(size=16) * rng.choice([0, 0.05, 0.1])
            rows.append((group * 10 + copy, (v * rng.choice([1.0, 1.0, 1e-200, 1e200])).tolist()))
    rows += [
        (900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] + [0.0] * 14), (904, [float("nan")] * 16),
        (905, [float("inf")] + [1.0] * 15), (None, rows[0][1]), (906, [1.0, 0.0]), (907, [1.0, 0.0]), (908, [-0.0, 1.0]),
        (rows[0][0], rows[0][1]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 AS label", "1 AS rep")
    found = vectors.near_duplicates(frame).collect()
    links = plain_links(rows)
    label = components([(rows[a][0], rows[b][0]) for a, b in links], {i for i, _ in rows if i is not None})
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    wanted = sorted(((i if i is not None else -1), degree[at]) for at, (i, _) in enumerate(rows))
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links) for r in found) == wanted
    for r in found:
        assert r.component_id == (label[r.vec_id] if r.vec_id is not None else None)
        assert r.kept == (r.vec_id is None or r.vec_id == r.component_id)


def test_dense_bucket_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.01 * rng.normal(size=8)).tolist()) for i in range(120)] + [(500, [1.0] * 8)] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(frame, block=16).collect()}
    linked = len(plain_links(rows[:121])) > 120 * 119 // 2
    assert {f for f in found if f[0] < 500} == {(i, 119 + 3 * linked, 0) for i in range(120)}
    assert (500, 2, 500) in found or linked


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(frame).collect() == []
