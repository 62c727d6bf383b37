"""What the optimiser makes of the jobs: scans, pushed filters, exchanges, joins."""

import re

import pytest
from pyspark.sql import functions as F

from patronlens.operators import anchor, clean, inventory, rfm
from patronlens.plans.customer_insights import CustomerInsights
from patronlens.sources import star_schema as star


def plan(df) -> str:
    """The plan that really ran, adaptive changes included."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def scans(text: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet .*{table}\.parquet", text))


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_attribute_join_reads_transactions_once(spark, small_data, no_broadcast):
    bundle = clean.clean_bundle(star.orders_bundle(spark, small_data))
    window = anchor.reporting_window(bundle.transactions)
    activity = rfm.customer_activity(bundle.transactions, [window])
    text = plan(rfm.with_attributes(activity, bundle.customers))
    assert scans(text, "orders") == 1
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_features_scan_only_needed_columns_and_push_filters(spark, small_data):
    orders = clean.clean_transactions(star.order_transactions(spark, small_data))
    text = plan(rfm.rfm_features(orders, anchor.reporting_window(orders)))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "LessThanOrEqual(o_orderdate" in pushed and "IsNotNull(o_custkey)" in pushed
    columns = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert {c.split(":")[0] for c in columns.split(",")} == {
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
    }
    # Orders are spread by (customer, order) first; customers get partial rows only.
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert "Expand" not in text and "Python" not in text


def test_window_filter_is_pushed(spark, small_data):
    orders = clean.clean_transactions(star.order_transactions(spark, small_data))
    text = plan(rfm.active_customers(orders, anchor.reporting_window(orders)))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThanOrEqual(o_orderdate" in pushed


def test_demand_reads_only_the_look_back(spark, small_data):
    sold = star.line_sales(spark, small_data)
    latest = anchor.find_anchor(sold, "sold_at")
    outlook = inventory.sku_outlook(star.part_inventory(spark, small_data), sold, latest)
    assert "GreaterThanOrEqual(l_shipdate" in plan(outlook)


def test_messages_are_neither_shuffled_nor_joined(spark, small_data):
    messages = star.table(spark, small_data, "conversations")
    with CustomerInsights(star.events_bundle(spark, small_data)) as run:
        text = plan(run.answer(messages, "text"))
    assert "Exchange" not in text and "Join" not in text and "Python" not in text


def test_top_list_does_not_sort_everything(spark, small_data):
    with CustomerInsights(star.events_bundle(spark, small_data)) as run:
        assert "TakeOrderedAndProject" in plan(run.top_customers)


def test_analysis_reads_transactions_twice_at_most(spark, small_data):
    """Once for the anchor and once for the persisted table that serves everything else."""
    with CustomerInsights(star.orders_bundle(spark, small_data), scorer="rule") as run:
        run.base.count()
        for part in (run.kpis, run.segment_counts, run.tests, run.top_customers):
            text = plan(part)
            assert "InMemoryTableScan" in text
        assert scans(plan(run.features), "orders") <= 1  # inside the cached relation only


def test_release_drops_the_persisted_tables(spark, small_data):
    with CustomerInsights(star.events_bundle(spark, small_data)) as run:
        run.base.count()
        table = run._table
        assert table.storageLevel.useMemory
    assert not table.storageLevel.useMemory


def test_results_do_not_depend_on_the_session_time_zone(spark, small_data):
    def found():
        with CustomerInsights(star.events_bundle(spark, small_data)) as run:
            return sorted(tuple(r) for r in run.scored.select(
                "customer_id", "last_order", "recencyDays", "segment", F.round("churnRisk", 9)
            ).collect())

    old = spark.conf.get("spark.sql.session.timeZone")
    expected = found()
    try:
        for zone in ("America/Sao_Paulo", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert found() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
