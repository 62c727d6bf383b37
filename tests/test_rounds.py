"""Behaviour that earlier versions got wrong."""


import pytest

from patronlens.functions.parsing import parse_timestamp
from patronlens.operators import anova, clean, insights, quality
from patronlens.operators.quantiles import exact_quantiles
from patronlens.plans import catalog
from patronlens.plans.customer_insights import CustomerInsights
from patronlens.sources.bundle import TableBundle, load_bundle
from patronlens.sources.delimited import drop_missing_tokens
from patronlens.streaming import refresh
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def test_cleaning_report_counts_what_cleaning_keeps(spark, small_data):
    dirty = drop_missing_tokens(catalog.repeated_export(spark, small_data))
    row = quality.cleaning_report(dirty).head()
    assert row["rows_retained"] == clean.clean_transactions(dirty).count()
    assert row["duplicates"] > 0


def test_stock_queries_show_every_band(spark, small_data):
    risks = {r["risk"] for r in catalog.QUERIES["sku_outlook"](spark, small_data).collect()}
    assert risks == {"High", "Medium", "Low"}
    assert catalog.QUERIES["reorder_alerts"](spark, small_data).count() > 0


def test_the_dimension_is_the_one_tested(spark):
    rows = [("x" if i % 2 else "y", "n" if i < 40 else "s", 10.0 + i % 3 + (200 if i < 40 else 0)) for i in range(80)]
    table = spark.createDataFrame(rows, "device_type string, location string, aov double")
    found = {r["name"]: r["result"] for r in anova.order_value_tests(table, "location", "device_type", "none").collect()}
    assert found == {
        "Avg order value differs by location": "significant",
        "Avg order value differs by device_type": "not_significant",
    }


def test_insights_keep_the_order_of_tests(spark):
    names = [f"t{i}" for i in (9, 3, 7, 1, 8, 2, 5, 4)]
    tests = spark.createDataFrame([(n, "ANOVA", 0.01, "significant") for n in sorted(names)], "name string, method string, pValue double, result string")
    features = spark.createDataFrame([("Moderate",)], "segment string")
    shown = [r["evidence"].split()[0] for r in insights.insights(features, tests, names).collect()]
    assert shown == names[:6]


def test_nan_is_no_value_for_quantiles(spark):
    frame = spark.range(101).select(F.when(F.col("id") == 100, float("nan")).otherwise(F.col("id")).cast("double").alias("x"))
    for most in (10, 1000):
        found = exact_quantiles(frame, {"x": [0.5, 1.0]}, max_ordered=most)["x"]
        assert (found[0.5].rows, found[0.5].value, found[1.0].value) == (100, 49.5, 99.0)


@pytest.mark.parametrize("kind,common", [("double", "double"), ("int", "bigint"), ("string", "string")])
def test_ids_of_two_types_meet(spark, transactions, kind, common):
    sold = transactions([("1", "7", "2024-01-01", 5)]).withColumn("customer_id", F.col("customer_id").cast("bigint"))
    people = spark.sql(f"SELECT CAST('7' AS {kind}) AS customer_id, CAST(NULL AS timestamp_ntz) AS account_creation_date")
    bundle = clean.clean_bundle(TableBundle(people, sold))
    assert dict(bundle.customers.dtypes)["customer_id"] == common
    assert bundle.customers.join(bundle.transactions, "customer_id").count() == 1


def test_iso_forms(spark):
    texts = ["2024-01-15T10:30:00Z", "2024-01-15 10:30:00+00:00", "2024-01-15 10", "20240115", "2024-01-15", "2024", "20241399", "2024-01-15T"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [str(r[0]) for r in frame.select(parse_timestamp(F.col("t"), StringType())).collect()]
    assert found == ["2024-01-15 10:30:00"] * 2 + ["2024-01-15 10:00:00"] + ["2024-01-15 00:00:00"] * 2 + ["None"] * 3


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_other_layouts_and_line_breaks_reach_the_analysis(spark, tmp_path):
    write(tmp_path / "customers.csv", "customer_id;name;account_creation_date\na;\"A\nB\";01/02/2024\n")
    lines = [f"o{i};a;{1 + i:02d}/03/2024;{i}" for i in range(9)]
    write(tmp_path / "transactions.csv", "order_id;customer_id;order_datetime;total_amount\n" + "\n".join(lines) + "\n")
    bundle = load_bundle(spark, str(tmp_path), multiline=True)
    with CustomerInsights(bundle, scorer="rule", date_formats=["dd/MM/yyyy"]) as run:
        rows = run.base.collect()
    assert [(r["customer_id"], r["name"], r["frequency"]) for r in rows] == [("a", "A\nB", 9)]


def test_files_with_other_headers_are_an_error(spark, tmp_path):
    write(tmp_path / "transactions.csv" / "a.csv", "id,amount\n1,2\n")
    write(tmp_path / "transactions.csv" / "b.csv", "amount,id\n2,1\n")
    from patronlens.sources.delimited import read_delimited

    with pytest.raises(Exception, match="header"):
        read_delimited(spark, str(tmp_path / "transactions.csv")).collect()


def test_stream_maps_missing_tokens_and_survives_removal(spark, tmp_path):
    schema = "order_id string, customer_id string, order_datetime string, total_amount string"
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    batches = [
        [("1", "a", "2024-01-01", "10"), ("1", "a", "2024-01-01", "20"), ("2", "NA", "2024-01-01", "5")],
        [("1", "a", "2024-01-02", "30"), ("3", "b", "2024-01-02", "7")],
        [("4", "a", "2024-01-03", "1")],
    ]
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        refresh.refresh_state(refresh.transaction_stream(spark, source, schema), state)
        if number == 1:
            refresh.compact_state(spark, state, remove=True)
    refresh.compact_state(spark, state, remove=True)
    rows = refresh.stored_rows(spark, state)
    values = {r["customer_id"]: r["aov"] for r in anova.average_order_value(rows).collect()}
    assert values == {"a": 61 / 4, "b": 7.0}


def test_stored_table_is_removed_on_release(spark, transactions, customers, tmp_path):
    made = transactions([(str(i), "a", f"2024-01-{1 + i:02d}", i) for i in range(9)])
    bundle = TableBundle(customers([("a", "n", "x")]), made)
    with CustomerInsights(bundle, scorer="rule", keep="storage", folder=str(tmp_path)) as run:
        assert run.base.count() == 1 and len(list(tmp_path.iterdir())) == 1
    assert list(tmp_path.iterdir()) == []
