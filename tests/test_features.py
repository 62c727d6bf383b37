from datetime import datetime

import pytest
from pyspark.sql import functions as F

from patronlens.operators.anchor import Window, check_days, reporting_window
from patronlens.operators.rfm import customer_activity, rfm_features, with_attributes
from patronlens.operators.segments import with_segments
from patronlens.plans.customer_insights import CustomerInsights, InsightsMemo
from patronlens.sources.bundle import TableBundle

LAST = ("end", "z", "2024-03-01 15:00:00", 1)  # puts the anchor at 2024-03-01 00:00


def features(transactions, rows, days=30):
    table = transactions([*rows, LAST])
    found = rfm_features(table, reporting_window(table, days)).collect()
    return {r["customer_id"]: r for r in found}


def test_anchor_is_midnight_of_the_last_day(transactions):
    assert reporting_window(transactions([LAST])).anchor == datetime(2024, 3, 1)


def test_orders_after_midnight_of_the_last_day_are_left_out(transactions):
    assert "z" not in features(transactions, [])


def test_recency_counts_whole_days(transactions):
    found = features(transactions, [
        ("1", "evening", "2024-02-29 18:00:00", 1), ("2", "day", "2024-02-29 00:00:00", 1),
        ("3", "midnight", "2024-03-01 00:00:00", 1),
    ])
    days = {c: r["recencyDays"] for c, r in found.items()}
    assert days == {"evening": 0, "day": 1, "midnight": 0}


def test_lines_of_one_order_count_once(transactions):
    row = features(transactions, [
        ("1", "a", "2024-02-01", 10), ("1", "a", "2024-02-02", 5), ("2", "a", "2023-01-01", 2),
    ])["a"]
    assert (row["frequency"], row["monetary"]) == (2, 17.0)
    assert (row["frequency90d"], row["monetary90d"]) == (1, 15.0)


def test_order_partly_inside_the_trailing_window(transactions):
    row = features(transactions, [
        ("1", "a", "2023-12-02", 3), ("1", "a", "2023-12-01 23:59:59", 4),
    ])["a"]
    assert (row["frequency90d"], row["monetary90d"]) == (1, 3.0)


def test_no_recent_order_gives_zero(transactions):
    row = features(transactions, [("1", "a", "2020-01-01", 3)])["a"]
    assert (row["frequency90d"], row["monetary90d"]) == (0, 0.0)


def test_window_limits_are_inclusive(transactions, customers):
    table = transactions([
        ("1", "start", "2024-01-31 00:00:00", 1), ("2", "before", "2024-01-30 23:59:59", 1),
        ("3", "end", "2024-03-01 00:00:00", 1), LAST,
    ])
    window = reporting_window(table)
    flagged = with_segments(rfm_features(table, window), window)
    active = {r["customer_id"]: r["isActiveInWindow"] for r in flagged.collect()}
    assert active == {"start": True, "before": False, "end": True}


def test_days_are_checked():
    assert check_days(7) == 7 and check_days(365) == 365
    for days in (6, 366):
        with pytest.raises(ValueError):
            check_days(days)


def test_attributes_of_unknown_and_repeated_customers(transactions, customers):
    table = transactions([("1", "a", "2024-02-01", 1), ("2", "b", "2024-02-01", 1), LAST])
    known = customers([("a", "A", "x"), ("a", "A2", "y"), ("idle", "I", "x")])
    joined = with_attributes(rfm_features(table, reporting_window(table)), known)
    found = sorted((r["customer_id"], r["name"] or "") for r in joined.collect())
    assert found == [("a", "A"), ("a", "A2"), ("b", "")]


def test_several_windows_share_one_pass(transactions):
    table = transactions([
        ("1", "a", "2024-01-01", 1), ("2", "a", "2024-02-10", 2), ("3", "b", "2024-02-20", 4),
        LAST,
    ])
    now = Window(datetime(2024, 3, 1), 30)
    then = Window(datetime(2024, 2, 1), 30)
    both = customer_activity(table, [now, then], ["", "_then"])
    for window, suffix in ((now, ""), (then, "_then")):
        alone = {r["customer_id"]: r.asDict() for r in rfm_features(table, window).collect()}
        kept = both.filter(F.col("frequency" + suffix) > 0).collect()
        assert {r["customer_id"] for r in kept} == set(alone)
        for r in kept:
            for name, value in alone[r["customer_id"]].items():
                assert r[name if name == "customer_id" else name + suffix] == value


def test_average_order_value_includes_the_last_day(transactions):
    table = transactions([("1", "a", "2024-02-01", 1), ("2", "a", "2024-03-01 10:00:00", 4)])
    row = customer_activity(table, [reporting_window(table)]).head()
    assert (row["monetary"], row["aov"]) == (1.0, 2.5)


def test_at_risk_outranks_top_buyer(transactions):
    rows = [("big", "big", "2023-01-01", 1000)] + [
        (f"o{i}", f"c{i}", "2024-02-20", 1) for i in range(3)
    ]
    table = transactions([*rows, LAST])
    window = reporting_window(table)
    found = with_segments(rfm_features(table, window), window).collect()
    assert {r["customer_id"]: r["segment"] for r in found}["big"] == "At-Risk"


def test_properties_on_generated_orders(spark, transactions, customers):
    rows = [
        (f"o{i}", f"c{i % 37}", f"2024-0{1 + i % 3}-{1 + i * 7 % 28:02d} {i % 24:02d}:00:00", i % 50)
        for i in range(400)
    ]
    bundle = TableBundle(customers([(f"c{i}", None, "d") for i in range(20)]), transactions(rows))
    with CustomerInsights(bundle, scorer="rule") as run:
        scored = run.scored.collect()
        assert len(scored) == sum(r["value"] for r in run.segment_counts.collect())
        assert all(0 <= r["churnRisk"] <= 1 for r in scored)
        assert all(r["monetary90d"] <= r["monetary"] for r in scored)
        start = datetime.combine(run.window.anchor.date(), datetime.min.time())
        for r in scored:
            assert r["isActiveInWindow"] == ((start - r["last_order"]).total_seconds() <= 30 * 86400)
        by_kpi = run.kpis.head()
        assert by_kpi["activeCustomers"] == sum(r["isActiveInWindow"] for r in scored)
        assert run.top_customers.count() == 12
        assert all(r["name"] == r["id"] for r in run.top_customers.collect())


def test_memo_returns_the_same_run_for_the_same_anchor(transactions, customers):
    bundle = TableBundle(customers([("a", "A", "x")]), transactions([("1", "a", "2024-02-01", 1), LAST]))
    memo = InsightsMemo()
    assert memo.get(bundle, 30) is memo.get(bundle, 30)
    assert memo.get(bundle, 30) is not memo.get(bundle, 7)
    memo.clear()


def test_missing_optional_customer_columns(spark, transactions):
    bare = spark.sql("SELECT 'a' AS customer_id, '2024-01-01' AS account_creation_date")
    bundle = TableBundle(bare, transactions([("1", "a", "2024-02-01", 1), LAST]))
    with CustomerInsights(bundle) as run:
        assert run.tests.count() == 0
        assert run.model.features == ("recencyDays", "frequency90d", "monetary90d")
        top = run.top_customers.head()
        assert (top["id"], top["name"]) == ("a", "a")


def test_no_order_before_the_anchor(transactions, customers):
    """All orders fall on the last day, after midnight: no features, but a complete response."""
    orders = [(f"o{i}", f"c{i}", "2024-03-01 10:00:00", i) for i in range(12)]
    known = customers([(f"c{i}", None, "x" if i < 6 else "y") for i in range(12)])
    with CustomerInsights(TableBundle(known, transactions(orders))) as run:
        assert run.base.count() == 0
        assert run.model.type == "rule_only"
        assert tuple(run.kpis.head()) == (0, 0.0, 0, 0.0)
        assert run.tests.count() == 1
        assert run.response().head()[0].startswith('{"range":{"days":30,"end":"2024-03-01"}')


def test_table_kept_in_storage_gives_the_same_result(transactions, customers):
    orders = [(f"o{i}", f"c{i % 5}", f"2024-02-{1 + i:02d}", i) for i in range(20)]
    bundle = TableBundle(customers([("c1", "n", "x")]), transactions([*orders, LAST]))
    results = []
    for keep in ("memory", "storage"):
        with CustomerInsights(bundle, scorer="rule", keep=keep) as run:
            results.append(sorted(map(str, run.scored.collect())))
    assert results[0] == results[1]
