"""One key with a third of all rows, or more: same results as brute force."""

import uuid
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from patronlens.operators.anchor import reporting_window, survey
from patronlens.operators.heavy import heavy_keys, merged_summary, summary
from patronlens.operators.joins import flag_members, hot_keys, join_unique
from patronlens.operators.quality import cleaning_report
from patronlens.operators.rfm import rfm_features, with_attributes
from patronlens.plans.customer_insights import CustomerInsights
from patronlens.sources.bundle import TableBundle

DAY = datetime(2024, 1, 1)


def rows(hot_share):
    """3,000 order lines; the hot customer has one huge order and many small ones."""
    made = []
    for i in range(3000):
        hot = i % 100 < hot_share
        customer = "hot" if hot else f"c{i % 211}"
        order = "huge" if hot and i % 2 else f"o{i // 2}"
        made.append((order, customer, str(DAY + timedelta(hours=i)), i % 89))
    return made


def brute_force(made):
    moments = [datetime.fromisoformat(ts) for _, _, ts, _ in made]
    end = datetime.combine(max(moments).date(), datetime.min.time())
    since = end - timedelta(days=90)
    found = defaultdict(lambda: [None, set(), 0.0, set(), 0.0])
    for (order, customer, _, amount), ts in zip(made, moments):
        if ts <= end:
            f = found[customer]
            f[0] = max(f[0] or ts, ts)
            f[1].add(order)
            f[2] += amount
            if ts >= since:
                f[3].add(order)
                f[4] += amount
    return {
        c: (last, len(orders), total, len(recent), recent_total, (end - last).days)
        for c, (last, orders, total, recent, recent_total) in found.items()
    }


@pytest.mark.parametrize("hot_share", [0, 34, 90])
def test_features(transactions, hot_share):
    made = rows(hot_share)
    table = transactions(made).repartition(8)
    found = rfm_features(table, reporting_window(table)).collect()
    assert {
        r["customer_id"]: (r["last_order"], r["frequency"], r["monetary"], r["frequency90d"],
                           r["monetary90d"], r["recencyDays"])
        for r in found
    } == brute_force(made)


def test_hot_customer_in_the_master_table(transactions, customers):
    made = rows(34)
    known = [("hot", f"n{i}", "x") for i in range(500)] + [(f"c{i}", None, "y") for i in range(150)]
    with CustomerInsights(TableBundle(customers(known), transactions(made)), scorer="rule") as run:
        ids = [r["customer_id"] for r in run.base.collect()]
    expected = brute_force(made)
    assert ids.count("hot") == 500
    assert len(ids) == 500 + len(expected) - 1
    assert set(ids) == set(expected)


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_joins_with_hot_keys(spark, broadcast):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        left = spark.range(100).selectExpr("id AS k", "id * 2 AS a")
        right = spark.range(900).selectExpr("IF(id < 300, 7, id) AS k", "id AS b")
        assert hot_keys(right, "k", 0.3) == [7] and hot_keys(right, "k", 0.34) == []
        for share, repeats in ((0.3, True), (0.9, True), (0.3, False)):
            joined = join_unique(left, right, "k", "left", repeats, share).collect()
            assert sorted(r["b"] for r in joined if r["k"] == 7) == list(range(300))
            assert {r["k"] for r in joined if r["b"] is None} == set(range(100)) - {7}
            assert len(joined) == 300 + 99
            inner = join_unique(left, right, "k", "inner", repeats, share)
            assert (inner.count(), inner.columns) == (300, ["k", "a", "b"])
            for ids, hits in ((8, 300), (7, 0)):
                members = spark.range(ids).selectExpr("id AS k")
                flagged = flag_members(right, members, "k", "f", share)
                assert (flagged.filter("f").count(), flagged.count()) == (hits, 900)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_equal_rows_of_a_hot_key_all_stay(spark):
    left = spark.range(10).selectExpr("id AS k", "id * 2 AS a")
    right = spark.range(500).selectExpr("IF(id < 400, 3, id) AS k", "IF(id < 300, 0, id) AS b")
    joined = join_unique(left, right, "k", "inner", repeats=True)
    assert (joined.count(), joined.filter("b = 0").count()) == (400, 300)


def test_duplicate_rows(spark):
    data = [("1", "a", "2024-01-01", "5")] * 400 + [("2", "a", "2024-01-01", "5")] * 2
    data += [("3", "a", "bad", "5")] * 50 + [("4", "b", "2024-01-01", "x")]
    frame = spark.createDataFrame(
        data, "order_id string, customer_id string, order_datetime string, total_amount string"
    )
    row = cleaning_report(frame).head()
    assert (row["rows_total"], row["rows_retained"], row["duplicates"]) == (453, 402, 400)
    assert row["retained_share"] == pytest.approx(402 / 453)


@pytest.fixture
def plain_shuffles(spark):
    """Joins by shuffle, with partitions as they are dealt."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    old = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def task_sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def jobs_while(spark, build):
    """What ``build`` returns, and how many jobs it has run."""
    group = f"watched-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "")
    made = build()
    spark.sparkContext.setJobGroup("rest", "")
    return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("equal_rows", [False, True])
def test_one_id_in_half_of_all_customers(spark, plain_shuffles, equal_rows):
    """No job before the join, and no task with more than a small part of the hot rows."""
    n = 40_000
    name = "'same'" if equal_rows else "concat('n', id)"
    known = spark.range(0, n, 1, 64).selectExpr("IF(id % 2 = 0, 7, id) AS customer_id", f"{name} AS device_type")
    figures = spark.range(100).selectExpr("id AS customer_id", "id * 2.0 AS aov")
    joined, jobs = jobs_while(spark, lambda: with_attributes(figures, known))
    assert jobs == 0
    sizes = task_sizes(joined)
    assert sum(sizes) == n // 2 + 100 and max(sizes) < n // 8
    inner, jobs = jobs_while(spark, lambda: join_unique(figures, known, "customer_id", "inner"))
    sizes = task_sizes(inner)
    assert jobs == 0 and sum(sizes) == n // 2 + 50 and max(sizes) < n // 8
    flagged, jobs = jobs_while(spark, lambda: flag_members(known, figures, "customer_id", "f"))
    sizes = task_sizes(flagged)
    assert jobs == 0 and sum(sizes) == n and max(sizes) < n // 8
    assert flagged.filter("f").count() == n // 2 + 50


def test_hot_customers_come_from_the_job_that_finds_the_anchor(spark, plain_shuffles, transactions, customers):
    table = transactions(rows(34))
    known = customers([("hot", f"n{i}", "x") for i in range(500)] + [("c1", None, "y")])
    (window, often), jobs = jobs_while(spark, lambda: survey(table, known))
    assert often.keys == ("hot",) and window == reporting_window(table) and jobs == 1
    assert survey(table, known, at="2024-03-01")[1] is None
    with pytest.raises(ValueError):
        survey(table.limit(0), known)
    assert survey(table, known.limit(0))[1].keys == ()


def test_summaries_of_parts_merge(spark):
    parts = [spark.range(300).selectExpr("IF(id < 200, 7, id) AS k"), spark.range(5000).selectExpr("id + 1000 AS k")]
    kept = [p.agg(summary("k").alias("s"), F.count("*").alias("n")) for p in parts]
    both = kept[0].unionByName(kept[1]).agg(merged_summary("s").alias("s"), F.sum("n").alias("n"))
    assert both.select(heavy_keys(F.col("s"), F.col("n"), 0.03)).head()[0] == [7]
    assert kept[1].select(heavy_keys(F.col("s"), F.col("n"))).head()[0] == []
    nulls = spark.range(10).selectExpr("cast(null as bigint) AS k")
    assert hot_keys(nulls, "k") == [] and hot_keys(nulls.limit(0), "k") == []
    for how in ("left", "inner"):
        joined = join_unique(spark.range(3).selectExpr("id AS k"), nulls.selectExpr("k", "1 AS b"), "k", how)
        assert joined.count() == (3 if how == "left" else 0)
