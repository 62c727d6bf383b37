from datetime import date, datetime, timedelta

import pytest

from patronlens.operators import inventory, quality, sales
from patronlens.operators.kpis import clv_trend, kpi_changes, retention_by_segment, top_customers

ANCHOR = datetime(2024, 3, 13)  # a Wednesday


@pytest.fixture
def sold(spark):
    def build(rows):
        typed = [
            (sku, datetime.fromisoformat(ts), float(units), float(revenue))
            for sku, ts, units, revenue in rows
        ]
        return spark.createDataFrame(
            typed, "sku string, sold_at timestamp_ntz, units double, revenue double"
        )

    return build


@pytest.fixture
def stock(spark):
    rows = [("a", "W1", 5, 10), ("a", "W2", 30, 10), ("b", "W1", 20, 20), ("c", "W1", 1, 2),
            ("c", "W2", 1, 2), ("d", "W1", 500, 5)]
    return spark.createDataFrame(
        rows, "sku string, warehouse_location string, stock_level bigint, reorder_threshold bigint"
    )


@pytest.fixture
def products(spark):
    rows = [("a", "A", "x", 2.0), ("b", "B", "x", 4.0), ("c", "C", "y", 1.0), ("d", "D", "y", 3.0)]
    return spark.createDataFrame(rows, "sku string, name string, category string, cost_price double")


def test_stock_risk_is_strictly_below_the_threshold(stock, products):
    assert tuple(inventory.stock_risk(stock).head()) == (3, 2)
    by_category = inventory.stock_risk_by_category(stock, products).collect()
    assert {r["category"]: r["skus_at_risk"] for r in by_category} == {"x": 1, "y": 1}


def test_outlook_and_alerts(stock, products, sold):
    first = ANCHOR - timedelta(days=27)
    history = sold([
        ("a", str(first), 280, 1), ("a", str(first - timedelta(seconds=1)), 999, 1),
        ("b", "2024-03-13 23:00:00", 56, 1), ("c", "2024-03-01", 28, 1), ("e", "2024-03-02", 28, 1),
        ("d", "2024-03-14", 5, 1),
    ])
    outlook = inventory.sku_outlook(stock, history, ANCHOR)
    found = {r["sku"]: (r["predicted_demand"], r["stock"], r["days_to_stock_out"], r["risk"])
             for r in outlook.collect()}
    assert found == {
        "a": (70.0, 35, 3.5, "Medium"), "b": (14.0, 20, 10.0, "Medium"),
        "c": (7.0, 2, 2.0, "High"), "e": (7.0, 0, 0.0, "High"),
    }
    top = inventory.top_skus(outlook, products, 2).collect()
    assert {r["sku"]: r["name"] for r in top} == {"a": "A", "b": "B"}
    assert {r["sku"] for r in inventory.reorder_alerts(outlook).collect()} == {"c", "e"}
    listed = inventory.reorder_message(outlook).collect()
    assert {(r["sku"], r["sku_count"]) for r in listed} == {("c", 2), ("e", 2)}
    assert inventory.reorder_message(outlook.filter("sku = 'a'")).collect() == []


def test_turnover_counts_a_year_of_sales(stock, products, sold):
    history = sold([
        ("a", "2023-03-15", 10, 1), ("a", "2023-03-14 23:59:59", 1000, 1), ("b", "2024-03-13", 5, 1),
    ])
    row = inventory.inventory_turnover(stock, products, history, ANCHOR).head()
    assert row["sold_cost"] == 40.0
    assert row["stock_cost"] == 35 * 2 + 20 * 4 + 2 * 1 + 500 * 3
    assert row["turnover"] == pytest.approx(40 / 1652)


def test_weekly_forecast(sold):
    weeks = {date(2024, 1, 22) + timedelta(weeks=i): 10.0 * (i + 1) for i in range(8)}
    del weeks[date(2024, 2, 12)]
    rows = [("a", f"{w + timedelta(days=2)} 12:00:00", 1, v) for w, v in weeks.items()]
    found = {r["week"]: (r["actual"], r["forecast"])
             for r in sales.weekly_forecast(sold(rows), ANCHOR).collect()}
    shown = [date(2024, 2, 19) + timedelta(weeks=i) for i in range(6)]
    assert sorted(found) == shown
    for w in shown:
        before = [weeks[b] for i in range(1, 5) if (b := w - timedelta(weeks=i)) in weeks]
        assert found[w] == (weeks.get(w), pytest.approx(sum(before) / len(before)))


def test_revenue_follows_a_straight_line(sold):
    rows = [("a", f"2024-01-{d:02d} 0{d % 9}:00:00", 1, 100 + 2 * d) for d in range(1, 11)]
    row = sales.revenue_forecast(sold(rows)).head()
    assert row["last_day"] == date(2024, 1, 10)
    assert row["slope"] == pytest.approx(2.0)
    assert row["forecast"] == pytest.approx(sum(100 + 2 * d for d in range(11, 41)))


def test_growth_and_trend(sold):
    history = sold([
        ("a", "2024-03-13 20:00:00", 1, 30), ("a", "2024-02-12", 1, 10), ("a", "2024-01-13", 1, 99),
        ("b", "2024-02-12", 1, 10), ("new", "2024-03-01", 1, 5), ("c", "2024-03-01", 1, 11),
        ("c", "2024-02-12", 1, 10),
    ])
    grown = sales.growth(history, "sku", ANCHOR)
    found = {r["sku"]: (r["current"], r["previous"], r["growth"]) for r in grown.collect()}
    assert found == {
        "a": (30.0, 10.0, 2.0), "b": (0.0, 10.0, -1.0), "new": (5.0, 0.0, None),
        "c": (11.0, 10.0, pytest.approx(0.1)),
    }
    assert [r["sku"] for r in sales.trending(grown, "sku", 2).collect()] == ["a", "c"]


def test_monthly_and_weekday_figures(spark, transactions):
    table = transactions([
        ("1", "a", "2024-01-01", 1), ("2", "a", "2024-01-31 23:59:59", 2), ("3", "b", "2024-02-01", 4),
    ])
    months = {r["month"]: (r["users"], r["revenue"]) for r in sales.monthly_figures(table).collect()}
    assert months == {"2024-01": (1, 3.0), "2024-02": (1, 4.0)}
    days = {r["weekday"]: r["visits"] for r in sales.visits_per_weekday(table, "order_datetime").collect()}
    assert days == {"Mon": 1, "Wed": 1, "Thu": 1}
    shares = {r["name"]: r["share"] for r in sales.share_by(table, "customer_id").collect()}
    assert shares == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}


def test_profile_and_retention(transactions):
    table = transactions([
        ("1", "a", "2023-09-12 23:59:59", 1), ("2", "a", "2023-09-13", 2), ("3", "b", "2024-03-13", 4),
    ])
    row = quality.profile(table, "customer_id", "order_datetime").head()
    assert tuple(row) == (3, 4, date(2023, 9, 12), date(2024, 3, 13), 2)
    kept = {r["policy"]: r["kept_rows"] for r in quality.retention_summary(table, ANCHOR).collect()}
    assert kept == {"3 Months": 1, "6 Months": 2, "1 Year": 3, "2 Years": 3, "Forever": 3}
    assert quality.apply_retention(table, ANCHOR, 6).count() == 2
    assert quality.apply_retention(table, ANCHOR, None) is table
    assert [r["order_id"] for r in quality.sample_rows(table, "order_id", 2).collect()] == ["1", "2"]


FEATURES = "customer_id string, last_order timestamp_ntz, frequency bigint, monetary double"


def test_trend_shows_the_latest_six_months(spark):
    rows = [(f"c{m}", datetime(2024, m, 1), 1, float(m)) for m in range(1, 9)]
    rows.append(("d", datetime(2024, 8, 31, 23), 1, 10.0))
    found = clv_trend(spark.createDataFrame(rows, FEATURES)).collect()
    assert [(r["month"], r["value"]) for r in found] == [
        ("2024-03", 3.0), ("2024-04", 4.0), ("2024-05", 5.0), ("2024-06", 6.0), ("2024-07", 7.0),
        ("2024-08", 9.0),
    ]


def test_top_customers_rank_and_fall_back_to_the_id(spark):
    rows = [("b", "n", "s", 1, 1, 5.0, 0.1), ("a", None, "s", 1, 1, 5.0, 0.1), ("c", "m", "s", 1, 1, 9.0, 0.1)]
    scored = spark.createDataFrame(
        rows,
        "customer_id string, name string, segment string, recencyDays int, frequency bigint,"
        " monetary double, churnRisk double",
    )
    assert [(r["id"], r["name"]) for r in top_customers(scored, 2).collect()] == [("c", "m"), ("a", "a")]


def test_changes_and_retention(spark):
    now = spark.sql("SELECT 12L AS activeCustomers, 0.5D AS retentionRate")
    then = spark.sql("SELECT 10L AS activeCustomers, 0D AS retentionRate")
    found = {r["kpi"]: r["deltaPct"] for r in kpi_changes(now, then).collect()}
    assert found == {"activeCustomers": pytest.approx(0.2), "retentionRate": None}
    rows = [("x", 1), ("x", 2), ("y", 5)]
    kept = retention_by_segment(spark.createDataFrame(rows, "segment string, frequency bigint"))
    assert {r["segment"]: r["retentionRate"] for r in kept.collect()} == {"x": 0.5, "y": 1.0}


def test_column_profile_follows_the_schema_and_merges(spark):
    rows = spark.range(20_000).selectExpr(
        "id", "IF(id % 4 = 0, NULL, concat('name ', id % 1000)) AS name", "id % 7 = 0 AS flag",
        "array(id) AS list", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 10 AS int)) AS at",
        "IF(id = 5, NULL, id / 2) AS `odd name`",
    )
    found = {r["column"]: r for r in quality.column_profile(rows, "id").collect()}
    assert [found[c]["nulls"] for c in ("id", "name", "flag", "list", "at", "odd name")] == [0, 5000, 0, 0, 0, 1]
    assert found["id"]["distinct_keys"] == 20_000 and found["name"]["distinct_keys"] is None
    assert abs(found["id"]["distinct_estimate"] - 20_000) < 1000 and abs(found["name"]["distinct_estimate"] - 750) < 40
    assert (found["name"]["least_text"], found["name"]["greatest_text"]) == ("name 1", "name 999")
    assert (found["odd name"]["least_number"], found["odd name"]["greatest_number"]) == (0, 9999.5)
    assert found["at"]["greatest_text"] == "2024-01-10 00:00:00" and found["list"]["least_text"] is None
    parts = [quality.column_parts(rows.filter(f"id % 3 = {i}")) for i in range(3)]
    merged = quality.merged_parts(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    whole = quality.column_parts(rows)
    plain = lambda df: sorted(map(tuple, df.drop("sketch").collect()))
    assert plain(merged) == plain(whole)
    empty = quality.column_profile(rows.limit(0), "id").collect()
    assert {(r["rows"], r["nulls"], r["distinct_estimate"]) for r in empty} == {(0, 0, 0)}


def test_rows_that_differ_in_where_a_null_stands_are_no_duplicates(spark):
    schema = "order_id string, customer_id string, order_datetime string, total_amount string, a string, b string"
    base = ("1", "c", "2024-01-01", "5")
    rows = [(*base, "x", None), (*base, None, "x"), (*base, None, "x"), (*base, None, None)]
    assert quality.cleaning_report(spark.createDataFrame(rows, schema)).head()["duplicates"] == 1
