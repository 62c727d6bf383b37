"""Line dedup: against plain counting, taken back, and both ways of dropping."""

import re
from collections import Counter

import pytest

from edge import TEXTS, documents
from patronlens.llm import lines

LOW = re.compile("[A-Z]")
ROWS = [(i, f"Shared line\n own {i}\n\n  SHARED LINE\t\nrare {i // 4}") for i in range(12)]
ROWS += [(100 + i, text) for i, (_, text) in enumerate(TEXTS)]
ROWS += [(None, "shared line\r\nrare 0"), (0, ROWS[0][1]), (200, "Éa\n" * 40_000 + "shared line"), (201, "ab\nab\nab\n")]


def plain_key(line):
    return LOW.sub(lambda m: m.group().lower(), line.strip(" \t\n\v\f\r"))


def plain_drop(rows, counted, least=10, chars=1):
    n = Counter(k for _, t in counted for k in {plain_key(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if n[plain_key(x)] < least]
        out.append((i if i is not None else -1, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out)


def got(frame, names=("n_lines_", "n_dropped")):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r[names[0]], r[names[1]]) for r in frame.collect())


def counts(index):
    return sorted((bytes(r.key), r.n_docs) for r in index.counts.collect())


@pytest.mark.parametrize("most", [lines.MAX_BROADCAST_BYTES, 0])
@pytest.mark.parametrize("least,chars", [(10, 1), (4, 1), (3, 7)])
def test_lines_match_plain_counting(spark, most, least, chars):
    docs = documents(spark, ROWS, clash="n_lines key n row_number")
    index = lines.insert(lines.empty_index(spark, least, chars), docs)
    out = lines.drop_repeated_lines(docs, index, known=True, max_broadcast_bytes=most)
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped"]
    assert got(out) == plain_drop(ROWS, ROWS, least, chars)
    assert out.where("n_lines <> 'x'").count() == 0


def test_deletion_takes_an_insertion_back(spark):
    base, more = documents(spark, ROWS[:20]), documents(spark, ROWS[5:])
    first = lines.insert(lines.empty_index(spark, 6), base)
    both = lines.insert(first, more)
    assert got(lines.drop_repeated_lines(base, both), ("n_lines", "n_dropped")) == plain_drop(ROWS[:20], ROWS[:20] + ROWS[5:], 6)
    back = lines.delete(both, more)
    assert counts(back) == counts(first)
    keys = [lines.hashed(plain_key(x).encode()) for _, t in ROWS for x in (t or "").split("\n")[:50]]
    probes = [lines.Filters(i.shards, [(r.shard, bytes(r.cells)) for r in i.filters.collect()]).probe(keys) for i in (first, back)]
    assert (probes[0] == probes[1]).all()
    strange = documents(spark, [(1, "never seen"), (2, "shared line")])
    assert got(lines.drop_repeated_lines(strange, back), ("n_lines", "n_dropped")) == [(1, "never seen", 1, 0), (2, "", 1, 1)]
    assert counts(lines.delete(lines.delete(both, base), more)) == []
    with pytest.raises(Exception, match="never inserted"):
        lines.delete(first, documents(spark, [(1, "never seen")]))


def test_wrongly_known_lines_stay(spark):
    """With fingerprints of one bit the filters know many lines by mistake."""
    docs = documents(spark, ROWS)
    index = lines.insert(lines.empty_index(spark, print_bits=1), docs)
    assert index.exceptions.count() > 5
    assert got(lines.drop_repeated_lines(docs, index), ("n_lines", "n_dropped")) == plain_drop(ROWS, ROWS)
    rows = [(1, "\n".join(f"never seen {i}" for i in range(50)) + "\nshared line")]
    assert got(lines.drop_repeated_lines(documents(spark, rows), index), ("n_lines", "n_dropped")) == [(1, rows[0][1][:-12], 51, 1)]


def test_empty_tables(spark):
    nothing = documents(spark, [])
    index = lines.insert(lines.empty_index(spark), nothing)
    assert counts(index) == [] and lines.drop_repeated_lines(nothing, index).count() == 0
    docs = documents(spark, ROWS[:2])
    assert got(lines.drop_repeated_lines(docs, index), ("n_lines", "n_dropped")) == plain_drop(ROWS[:2], [])


def test_cuckoo_filter_holds_and_gives_up_keys(spark):
    keys = [lines.hashed(str(i).encode()) for i in range(5000)]
    _, prints, firsts = lines._places(keys, 1)
    made = lines.CuckooFilter.of(prints[:4000], firsts[:4000])
    for i in range(1000):
        assert made.delete(int(prints[i]), int(firsts[i]))
    found = lines.Filters(1, [(0, made.cells.astype("<u2").tobytes())]).probe(keys)
    assert found[1000:4000].all() and found[:1000].sum() + found[4000:].sum() < 20


@pytest.mark.parametrize("shards", [1, 2, 8])
def test_shard_column_and_numpy_agree(spark, shards):
    keys = [lines.hashed(str(i).encode()) for i in range(50)]
    frame = spark.createDataFrame([(k,) for k in keys], "key binary")
    rows = {bytes(r.key): r.s for r in frame.withColumn("s", lines._shard(shards)).collect()}
    assert [rows[k] for k in keys] == lines._places(keys, shards)[0].tolist()


def test_many_keys_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 16)
    rows = [(i, "\n".join(f"line {j}" for j in range(200) if j % 7 >= i % 7)) for i in range(40)]
    docs = documents(spark, rows)
    index = lines.insert(lines.empty_index(spark, 12), documents(spark, rows[:15]))
    index = lines.insert(index, documents(spark, rows[15:]))
    assert index.shards > 2
    assert got(lines.drop_repeated_lines(docs, index), ("n_lines", "n_dropped")) == plain_drop(rows, rows, 12)
