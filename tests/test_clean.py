from datetime import datetime

import pytest

from patronlens.operators.anchor import find_anchor
from patronlens.operators.clean import clean_bundle, clean_customers, clean_transactions
from patronlens.sources.bundle import TableBundle
from patronlens.sources.delimited import drop_missing_tokens

COLUMNS = "order_id, customer_id, order_datetime, total_amount, quantity, coupon_applied"
SCHEMA = ", ".join(f"{c.strip()} string" for c in COLUMNS.split(","))
GOOD = ("o", "c", "2024-01-05 18:00:00", "12", "1", "no")


def cleaned(spark, **changes):
    row = dict(zip([c.strip() for c in COLUMNS.split(",")], GOOD)) | changes
    frame = spark.createDataFrame([tuple(row.values())], SCHEMA)
    return clean_transactions(drop_missing_tokens(frame)).collect()


@pytest.mark.parametrize(
    "changes",
    [
        {"order_datetime": "bad"}, {"order_datetime": ""}, {"order_datetime": "2024-02-30"},
        {"order_datetime": "20240105123"}, {"order_datetime": "12:30:00"},
        {"total_amount": "abc"}, {"total_amount": "5d"}, {"total_amount": "1,000"},
        {"total_amount": "NA"}, {"total_amount": "null"}, {"total_amount": ""},
        {"total_amount": "NaN"}, {"customer_id": None}, {"customer_id": "N/A"},
        {"order_id": None},
    ],
)
def test_unusable_row_is_dropped(spark, changes):
    assert cleaned(spark, **changes) == []


@pytest.mark.parametrize(
    ("text", "value"),
    [(" 12 ", 12.0), ("-1.5", -1.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0),
     ("inf", float("inf")), ("-Infinity", float("-inf"))],
)
def test_number_forms(spark, text, value):
    assert cleaned(spark, total_amount=text)[0]["total_amount"] == value


@pytest.mark.parametrize(
    ("text", "value"),
    [("2024-01-05", datetime(2024, 1, 5)), ("2024-01-05T06:07:08", datetime(2024, 1, 5, 6, 7, 8)),
     (" 2024-01-05 06:07 ", datetime(2024, 1, 5, 6, 7)),
     ("2024-01-05 06:07:08.25", datetime(2024, 1, 5, 6, 7, 8, 250000))],
)
def test_date_forms(spark, text, value):
    assert cleaned(spark, order_datetime=text)[0]["order_datetime"] == value


def test_bad_optional_number_keeps_the_row(spark):
    assert cleaned(spark, quantity="abc")[0]["quantity"] is None


@pytest.mark.parametrize(
    ("text", "flag"),
    [("TRUE", True), ("true", True), ("True", True), ("FALSE", False), ("yes", False),
     (" TRUE ", False), (None, False)],
)
def test_coupon_flag(spark, text, flag):
    assert cleaned(spark, coupon_applied=text)[0]["coupon_applied"] is flag


def test_other_date_layouts_are_an_option(spark):
    frame = spark.createDataFrame(
        [("o", "c", "05.01.2024", "1")],
        "order_id string, customer_id string, order_datetime string, total_amount string",
    )
    assert clean_transactions(frame).count() == 0
    row = clean_transactions(frame, ["dd.MM.yyyy"]).head()
    assert row["order_datetime"] == datetime(2024, 1, 5)


def test_customers_without_id_are_dropped(spark):
    frame = spark.createDataFrame(
        [("a", "2024-01-01", "x"), (None, "2024-01-01", "2"), ("b", "bad", "3")],
        "customer_id string, account_creation_date string, avg_session_time_min string",
    )
    rows = {r["customer_id"]: r for r in clean_customers(frame).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["avg_session_time_min"] is None
    assert rows["b"]["account_creation_date"] is None


def test_keys_of_different_types_become_text(spark, transactions):
    numbers = spark.sql("SELECT 7L AS customer_id, cast(null as string) AS account_creation_date")
    bundle = TableBundle(numbers, transactions([("o", "7", "2024-01-01", 1)]))
    done = clean_bundle(bundle)
    assert done.customers.schema["customer_id"].dataType.simpleString() == "string"
    assert done.customers.join(done.transactions, "customer_id").count() == 1


def test_no_valid_date_is_an_error(transactions):
    with pytest.raises(ValueError, match="No valid order_datetime"):
        find_anchor(transactions([]))
