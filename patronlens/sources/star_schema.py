"""Map the star-schema Parquet tables onto the tables the analyses expect.

``orders`` mapping: orders are transactions, customers are customers, the market segment
plays the device dimension and event statistics per user supply the behaviour columns.
``events`` mapping: purchase events are transactions and event users are customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from patronlens.sources.bundle import TableBundle


# The columns of the tables. Stating them saves a look into the files.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
        " c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
        " value double, props string"
    ),
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def as_transactions(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_datetime"),
        F.col("o_totalprice").alias("total_amount"),
    )


def order_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return as_transactions(table(spark, folder, "orders"))


def order_customers(spark: SparkSession, folder: str) -> DataFrame:
    behaviour = (
        table(spark, folder, "events")
        .filter(F.col("event_type").isin("view", "click"))
        .groupBy("user_id")
        .agg(
            F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias(
                "avg_session_time_min"
            ),
            F.count_if(F.col("event_type") == "click").cast("double").alias(
                "wishlist_items_count"
            ),
        )
    )
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    customer = table(spark, folder, "customer")
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(behaviour, customer.c_custkey == behaviour.user_id, "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.lit(None).cast("timestamp_ntz").alias("account_creation_date"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("device_type"),
            "avg_session_time_min",
            "wishlist_items_count",
            F.col("n_name").alias("location"),
        )
    )


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").alias("order_id"),
            F.col("user_id").alias("customer_id"),
            F.col("ts").alias("order_datetime"),
            F.col("value").alias("total_amount"),
        )
    )


def event_customers(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .select(F.col("user_id").alias("customer_id"))
        .distinct()
        .withColumn("account_creation_date", F.lit(None).cast("timestamp_ntz"))
    )


def part_products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("cost_price"),
    )


def part_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (part, supplier) pair seen in line items.

    The tables hold no stock levels, so level and threshold come from key arithmetic.
    """
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    return (
        table(spark, folder, "lineitem")
        .select("l_partkey", "l_suppkey")
        .distinct()
        .select(
            part.alias("sku"),
            supplier.alias("warehouse_location"),
            ((part * 7 + supplier * 13) % 299 + 1).alias("stock_level"),
            ((part * 3 + supplier * 5) % 60 + 20).alias("reorder_threshold"),
        )
    )


def scarce_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """The same warehouses with stock run down by key: a part may be out, short or well stocked."""
    percent = F.when(F.col("sku") % 2 == 0, 0).when(F.col("sku") % 3 == 0, 1).otherwise(100)
    held = F.floor(F.col("stock_level") * percent / 100).cast("long")
    return part_inventory(spark, folder).withColumn("stock_level", held)


def line_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Units and revenue per shipped line; the sales history of the inventory reports."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("sku"),
        F.col("l_shipdate").alias("sold_at"),
        F.col("l_quantity").alias("units"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )


def orders_bundle(spark: SparkSession, folder: str) -> TableBundle:
    return TableBundle(
        customers=order_customers(spark, folder),
        transactions=order_transactions(spark, folder),
    )


def events_bundle(spark: SparkSession, folder: str) -> TableBundle:
    return TableBundle(
        customers=event_customers(spark, folder),
        transactions=event_transactions(spark, folder),
    )
