import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from patronlens.session import local_session  # noqa: E402

SMALL_DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_data():
    if not os.path.isdir(SMALL_DATA):
        pytest.skip("test tables are not available")
    return SMALL_DATA


@pytest.fixture
def transactions(spark):
    """Typed transactions from (order, customer, 'YYYY-MM-DD[ HH:MM:SS]', amount) rows."""

    def build(rows):
        typed = [
            (order, customer, datetime.fromisoformat(ts), float(amount))
            for order, customer, ts, amount in rows
        ]
        schema = (
            "order_id string, customer_id string, order_datetime timestamp_ntz,"
            " total_amount double"
        )
        return spark.createDataFrame(typed, schema)

    return build


@pytest.fixture
def customers(spark):
    """Customers from (id, name, device) rows."""

    def build(rows):
        schema = "customer_id string, name string, device_type string"
        frame = spark.createDataFrame(rows, schema)
        return frame.selectExpr("*", "cast(null as timestamp_ntz) AS account_creation_date")

    return build
