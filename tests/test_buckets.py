"""Bucketed stream state: equal to a full run, and blind to everything a batch does not concern."""

import math
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from patronlens.operators.anchor import reporting_window
from patronlens.operators.clean import clean_transactions
from patronlens.operators.rfm import customer_activity
from patronlens.operators.segments import segment_thresholds, with_segments
from patronlens.streaming import counting_tree
from patronlens.streaming.buckets import BucketedState

SCHEMA = "order_id string, customer_id string, order_datetime string, total_amount string"
DAY = datetime(2024, 1, 1)


def orders(seed, n, first_day, last_day, customers=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        moment = DAY + timedelta(days=rng.randrange(first_day, last_day + 1), hours=rng.choice([0, 9, 18]))
        rows.append((f"{seed}-{i // 2}", f"c{rng.randrange(customers)}", str(moment), str(rng.randrange(1, 400) / 4)))
    return rows


def clean(spark, rows):
    return clean_transactions(spark.createDataFrame(rows, SCHEMA))


def plain(frame):
    return sorted(tuple(r) for r in frame.collect())


def expected(spark, rows):
    table = clean(spark, rows)
    window = reporting_window(table)
    features = customer_activity(table, [window]).filter("frequency > 0")
    limits = segment_thresholds(features)
    return plain(features), limits, plain(with_segments(features, window, limits))


def check(spark, state, rows):
    features, limits, segments = expected(spark, rows)
    assert plain(state.features()) == features
    assert state.thresholds() == limits
    assert plain(with_segments(state.features(), state.window, state.thresholds())) == segments


BATCHES = [
    orders(1, 300, 0, 100), orders(2, 40, 90, 101), orders(3, 3, 101, 101), orders(4, 30, 150, 260),
    orders(5, 5, 3, 20), [("x", "c1", "bad", "1")], orders(6, 200, 0, 261, customers=90),
]


def test_state_equals_a_full_run_after_every_batch(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path / "state"), buckets=8, leaf_values=6)
    seen = []
    for number, batch in enumerate(BATCHES):
        before = {} if not number else {r["customer_id"]: r for r in state.features().collect()}
        changed, report = state.update(clean(spark, batch), number)
        seen += batch
        check(spark, state, seen)
        after = {r["customer_id"]: r for r in state.features().collect()}
        names = ["last_order", "frequency", "monetary", "frequency90d", "monetary90d", "aov"]
        moved = {c for c, r in after.items() if c not in before or any(r[n] != before[c][n] for n in names)}
        assert {r["customer_id"] for r in changed.collect()} == moved
    assert plain(state.rows().groupBy("customer_id").agg(F.sum("row_count"))) == plain(
        clean(spark, seen).groupBy("customer_id").count()
    )
    state.remove_unused()
    check(spark, state, seen)
    state.update(clean(spark, orders(9, 4, 255, 262)), len(BATCHES))


def test_a_repeated_batch_counts_once(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path), buckets=4, leaf_values=5)
    for number in (0, 1, 1, 2, 2):
        state.update(clean(spark, BATCHES[number]), number)
    check(spark, state, sum(BATCHES[:3], []))


def test_a_small_batch_reads_only_its_buckets_and_leaves(spark, tmp_path):
    """Files of all other buckets and leaves are taken away while the batch runs."""
    state = BucketedState(spark, str(tmp_path / "state"), buckets=32, leaf_values=10)
    first = orders(1, 1200, 0, 100, customers=400) + [("last", "c0", str(DAY + timedelta(days=100, hours=12)), "1")]
    state.update(clean(spark, first), 0)
    batch = [("new-1", "c7", str(DAY + timedelta(days=50)), "3"), ("new-2", "c9", str(DAY + timedelta(days=60)), "4")]
    added = clean(spark, batch)
    own = {r["b"] for r in added.select(state._bucket().alias("b")).collect()}
    manifest = state._manifest()

    apart = tmp_path / "apart"
    hidden = []
    for kind in ("rows", "features"):
        hidden += [f"{kind}/batch=0/bucket={k}" for k in manifest.buckets if k not in own]
    values = {"monetary": [], "frequency": [], "last_order": []}
    old = {r["customer_id"]: r for r in state.features().collect()}
    for c in ("c7", "c9"):
        amount = 3 if c == "c7" else 4
        values["monetary"] += [old[c]["monetary"], old[c]["monetary"] + amount]
        values["frequency"] += [old[c]["frequency"], old[c]["frequency"] + 1]
        values["last_order"].append((old[c]["last_order"] - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    for field, leaves in manifest.leaves.items():
        needed = {max(x.id for x in leaves if x.low <= v) for v in values[field]}
        hidden += [x.path for x in leaves if x.id not in needed and x.n]
    assert len(hidden) > 80
    for name in hidden:
        (apart / name).parent.mkdir(parents=True, exist_ok=True)
        os.rename(tmp_path / "state" / name, apart / name)
    changed, report = state.update(added, 1)
    assert {r["customer_id"] for r in changed.collect()} == {"c7", "c9"}
    assert set(report.buckets) == own and report.leaves <= 8
    assert report.rows_read == sum(manifest.buckets[k][1] for k in own) < 1200 // 8
    for name in hidden:
        os.rename(apart / name, tmp_path / "state" / name)
    check(spark, state, first + batch)


def test_limits_come_from_a_leaf_or_two(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path), buckets=4, leaf_values=10)
    state.update(clean(spark, orders(1, 900, 0, 100, customers=300)), 0)
    wanted, read = state.thresholds(), []
    plain_read = counting_tree._read

    def watched(spark, folder, leaves):
        read.extend(leaves)
        return plain_read(spark, folder, leaves)

    counting_tree._read = watched
    try:
        assert state.thresholds() == wanted
    finally:
        counting_tree._read = plain_read
    assert len(read) <= 8 < sum(map(len, state._manifest().leaves.values())) / 4


def test_stream_into_buckets(spark, tmp_path):
    import shutil

    source, state = tmp_path / "in", BucketedState(spark, str(tmp_path / "state"), buckets=8)
    source.mkdir()
    reports, rows = [], []
    for name, batch in (("one", BATCHES[0]), ("two", BATCHES[2])):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name))
        shutil.copy(next((tmp_path / name).glob("part-*.parquet")), source / f"{name}.parquet")
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        state.refresh(stream, lambda changed, report: reports.append((changed.count(), report)))
        rows += batch
        check(spark, state, rows)
    assert [r.batch for _, r in reports] == [0, 1] and reports[1][0] < reports[0][0]


def test_no_rows_and_wrong_bucket_count(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path), buckets=4)
    changed, report = state.update(clean(spark, BATCHES[5]), 0)
    assert changed.count() == 0 and report.buckets == () and state.window is None
    assert state.thresholds().monetary_q75 is None
    state.update(clean(spark, BATCHES[0]), 1)
    check(spark, state, BATCHES[0])
    with pytest.raises(ValueError, match="4 buckets"):
        BucketedState(spark, str(tmp_path), buckets=5).window


def test_trees_are_built_again_when_a_leaf_outgrows_them(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path), buckets=4, leaf_values=4)
    state.update(clean(spark, orders(1, 20, 0, 9, customers=8)), 0)
    few = sum(map(len, state._manifest().leaves.values()))
    more = orders(2, 300, 0, 100, customers=200)
    state.update(clean(spark, more), 1)
    assert sum(map(len, state._manifest().leaves.values())) > 3 * few
    check(spark, state, orders(1, 20, 0, 9, customers=8) + more)


def test_values_outside_all_leaves(spark, tmp_path):
    """Smaller and larger than whatever the trees were built from."""
    state = BucketedState(spark, str(tmp_path), buckets=2, leaf_values=3)
    rows = orders(1, 30, 20, 40, customers=20)
    state.update(clean(spark, rows), 0)
    extreme = [("a", "new1", str(DAY), "-5"), ("b", "new2", str(DAY + timedelta(days=39)), "1e9"), ("c", "new3", str(DAY - timedelta(days=4000)), "0")]
    state.update(clean(spark, extreme), 1)
    check(spark, state, rows + extreme)
    assert not math.isnan(state.thresholds().monetary_q75)
