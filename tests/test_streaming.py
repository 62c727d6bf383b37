import shutil

from patronlens.operators.anchor import reporting_window
from patronlens.operators.rfm import customer_activity
from patronlens.streaming import refresh

SCHEMA = "order_id string, customer_id string, order_datetime string, total_amount string"
FIRST = [
    ("1", "a", "2024-01-05 10:00:00", "5"), ("1", "a", "2024-01-05 11:00:00", "7"),
    ("2", "b", "2024-02-10 00:00:00", "1"), ("x", "b", "bad", "1"),
]
SECOND = [
    ("1", "a", "2024-01-05 12:00:00", "2"), ("3", "a", "2024-03-01 00:00:00", "3"),
    ("3", "a", "2024-03-01 09:00:00", "100"), ("4", "c", "2024-03-01 08:00:00", "9"),
]


def write(spark, rows, folder, name):
    """One file per call, as a producer would drop it into the folder."""
    staging = folder.parent / f"staging-{name}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(staging))
    folder.mkdir(exist_ok=True)
    shutil.copy(next(staging.glob("part-*.parquet")), folder / f"{name}.parquet")


def features(rows):
    found = customer_activity(rows, [reporting_window(rows)]).collect()
    return sorted(tuple(r) for r in found)


def direct(spark, rows):
    from patronlens.operators.clean import clean_transactions

    return features(clean_transactions(spark.createDataFrame(rows, SCHEMA)))


def test_state_equals_a_batch_run_after_every_refresh(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    seen = []
    note = lambda rows, number: seen.append((number, rows.count()))

    write(spark, FIRST, source, "one")
    stream = refresh.transaction_stream(spark, str(source), SCHEMA)
    refresh.refresh_state(stream, state, note)
    assert features(refresh.stored_rows(spark, state)) == direct(spark, FIRST)

    write(spark, SECOND, source, "two")
    refresh.refresh_state(refresh.transaction_stream(spark, str(source), SCHEMA), state, note)
    assert features(refresh.stored_rows(spark, state)) == direct(spark, FIRST + SECOND)
    assert [number for number, _ in seen] == [0, 1]

    # Nothing new: nothing changes.
    refresh.refresh_state(refresh.transaction_stream(spark, str(source), SCHEMA), state, note)
    assert features(refresh.stored_rows(spark, state)) == direct(spark, FIRST + SECOND)


def test_compaction_keeps_the_result(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    write(spark, FIRST, source, "one")
    refresh.refresh_state(refresh.transaction_stream(spark, str(source), SCHEMA), state)
    refresh.compact_state(spark, state)
    refresh.compact_state(spark, state)
    assert features(refresh.stored_rows(spark, state)) == direct(spark, FIRST)

    write(spark, SECOND, source, "two")
    refresh.refresh_state(refresh.transaction_stream(spark, str(source), SCHEMA), state)
    assert features(refresh.stored_rows(spark, state)) == direct(spark, FIRST + SECOND)
    refresh.compact_state(spark, state)
    rows = refresh.stored_rows(spark, state)
    assert features(rows) == direct(spark, FIRST + SECOND)
    assert rows.count() == 5  # order 3 keeps its midnight part apart


def test_repeated_batch_is_not_counted_twice(spark, tmp_path):
    from patronlens.operators.clean import clean_transactions

    batch = clean_transactions(spark.createDataFrame(FIRST, SCHEMA))
    for _ in range(2):
        refresh.partial_rows(batch).write.mode("overwrite").parquet(f"{tmp_path}/rows/batch=0")
    assert features(refresh.stored_rows(spark, str(tmp_path))) == direct(spark, FIRST)
