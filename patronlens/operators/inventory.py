"""Stock-out risk, demand, reorder alerts and turnover."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

# Look-back of the daily demand, horizons, risk limits and list lengths.
DEMAND_DAYS = 28
HORIZON_DAYS = 7
HIGH_RISK_DAYS = 3
MEDIUM_RISK_DAYS = 10
TOP_SKUS = 8
TURNOVER_DAYS = 365


def _moment(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _last_days(anchor: datetime, days: int) -> Column:
    """The calendar days up to and including the anchor day, as a filter on ``sold_at``."""
    day_after = _moment(anchor + timedelta(days=1))
    first = _moment(anchor + timedelta(days=1 - days))
    return (F.col("sold_at") >= first) & (F.col("sold_at") < day_after)


def understocked(inventory: DataFrame) -> DataFrame:
    """SKUs with at least one warehouse below its reorder threshold."""
    return (
        inventory.filter(F.col("stock_level") < F.col("reorder_threshold"))
        .select("sku")
        .distinct()
    )


def stock_risk(inventory: DataFrame) -> DataFrame:
    """One row: warehouse rows at risk and distinct SKUs at risk."""
    low = F.col("stock_level") < F.col("reorder_threshold")
    per_sku = inventory.filter(low).groupBy("sku").agg(F.count("*").alias("rows"))
    return per_sku.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_at_risk"),
        F.count("*").alias("skus_at_risk"),
    )


def stock_risk_by_category(inventory: DataFrame, products: DataFrame) -> DataFrame:
    return (
        understocked(inventory)
        .join(products.select("sku", "category").distinct(), "sku")
        .groupBy("category")
        .agg(F.count("*").alias("skus_at_risk"))
    )


def sku_outlook(
    inventory: DataFrame,
    sales: DataFrame,
    anchor: datetime,
    horizon: int = HORIZON_DAYS,
) -> DataFrame:
    """Demand, stock, days to stock-out and risk for every SKU sold in the look-back.

    Both sides are summed per SKU before the join, so the join sees one row per SKU however
    unevenly the sales are spread.
    """
    daily = (
        sales.filter(_last_days(anchor, DEMAND_DAYS))
        .groupBy("sku")
        .agg((F.sum("units") / DEMAND_DAYS).alias("daily_units"))
    )
    stock = inventory.groupBy("sku").agg(F.sum("stock_level").alias("stock"))
    days = F.try_divide(F.col("stock").cast("double"), F.col("daily_units"))
    risk = (
        F.when(F.col("days_to_stock_out") <= HIGH_RISK_DAYS, "High")
        .when(F.col("days_to_stock_out") <= MEDIUM_RISK_DAYS, "Medium")
        .otherwise("Low")
    )
    return (
        daily.join(stock, "sku", "left")
        .select(
            "sku",
            (F.col("daily_units") * horizon).alias("predicted_demand"),
            F.coalesce("stock", F.lit(0)).alias("stock"),
            F.coalesce(days, F.lit(0.0)).alias("days_to_stock_out"),
        )
        .withColumn("risk", risk)
    )


def top_skus(outlook: DataFrame, products: DataFrame, k: int = TOP_SKUS) -> DataFrame:
    """The SKUs with the highest predicted demand; names are joined to those k rows only."""
    top = outlook.orderBy(F.desc("predicted_demand"), "sku").limit(k)
    return top.join(products.select("sku", "name", "category"), "sku", "left")


def reorder_alerts(outlook: DataFrame) -> DataFrame:
    """One row per SKU that runs out within the high-risk limit."""
    return outlook.filter(F.col("risk") == "High").select(
        "sku", "stock", "predicted_demand", "days_to_stock_out"
    )


def reorder_message(outlook: DataFrame) -> DataFrame:
    """Every SKU that needs reordering with its days left, and how many they are."""
    alerts = reorder_alerts(outlook)
    count = alerts.agg(F.count("*").alias("n")).scalar()
    return alerts.select("sku", "days_to_stock_out", count.alias("sku_count"))


def inventory_turnover(
    inventory: DataFrame, products: DataFrame, sales: DataFrame, anchor: datetime
) -> DataFrame:
    """One row: cost of the units sold in the last year over the cost of the stock."""
    sold = (
        sales.filter(_last_days(anchor, TURNOVER_DAYS))
        .groupBy("sku")
        .agg(F.sum("units").alias("quantity"))
        .select("sku", "quantity", F.lit(0.0).alias("held"))
    )
    held = (
        inventory.groupBy("sku")
        .agg(F.sum("stock_level").cast("double").alias("held"))
        .select("sku", F.lit(0.0).alias("quantity"), "held")
    )
    cost = F.col("cost_price")
    return (
        sold.unionByName(held)
        .groupBy("sku")
        .agg(F.sum("quantity").alias("quantity"), F.sum("held").alias("held"))
        .join(products.groupBy("sku").agg(F.max("cost_price").alias("cost_price")), "sku")
        .agg(
            F.sum(F.col("quantity") * cost).alias("sold_cost"),
            F.sum(F.col("held") * cost).alias("stock_cost"),
        )
        .withColumn("turnover", F.try_divide(F.col("sold_cost"), F.col("stock_cost")))
    )
