"""Recency, frequency and monetary features per customer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from patronlens.fixed_values import CUSTOMER_ATTRIBUTES
from patronlens.functions.dates import whole_days_between
from patronlens.operators.anchor import Window
from patronlens.operators.heavy import HeavyKeys
from patronlens.operators.joins import join_unique

FEATURES = [
    "last_order", "frequency", "monetary", "frequency90d", "monetary90d", "recencyDays",
]


def _order_figures(window: Window, i: int) -> list[Column]:
    """Aggregates per (customer, order) for one window."""
    ts, amount = F.col("order_datetime"), F.col("total_amount")
    past = ts <= window.end
    recent = past & (ts >= window.since)
    return [
        F.max(F.when(past, ts)).alias(f"last{i}"),
        F.sum(F.when(past, amount)).alias(f"amount{i}"),
        F.max(recent).alias(f"recent{i}"),
        F.sum(F.when(recent, amount)).alias(f"recent_amount{i}"),
    ]


def _customer_figures(i: int) -> list[Column]:
    """Aggregates per customer for one window; orders outside it have no last date."""
    return [
        F.max(f"last{i}").alias(f"last{i}"),
        F.count(f"last{i}").alias(f"orders{i}"),
        F.sum(f"amount{i}").alias(f"amount{i}"),
        F.count_if(f"recent{i}").alias(f"recent_orders{i}"),
        F.coalesce(F.sum(f"recent_amount{i}"), F.lit(0.0)).alias(f"recent_amount{i}"),
    ]


def _named(window: Window, i: int, suffix: str) -> list[Column]:
    values = [
        F.col(f"last{i}"), F.col(f"orders{i}"), F.col(f"amount{i}"),
        F.col(f"recent_orders{i}"), F.col(f"recent_amount{i}"),
        whole_days_between(F.col(f"last{i}"), window.end),
    ]
    return [v.alias(name + suffix) for name, v in zip(FEATURES, values)]


def customer_activity(
    transactions: DataFrame, windows: Sequence[Window], suffixes: Sequence[str] = ("",)
) -> DataFrame:
    """One row per customer: features for every window, and ``aov`` over all dates.

    One pass over the transactions serves all windows and the average order value.
    Distinct orders are counted by going through (customer, order) grain: the first exchange
    spreads even a customer with a third of all rows over every task, and the second one
    carries only partial aggregates. ``frequency`` is 0 where a window saw no order.
    """
    numbered = list(enumerate(windows))
    # Partial rows from the stored stream state stand for several transactions.
    rows = F.sum("row_count") if "row_count" in transactions.columns else F.count("*")
    orders = transactions.groupBy("customer_id", "order_id").agg(
        *[c for i, w in numbered for c in _order_figures(w, i)],
        F.sum("total_amount").alias("total"),
        rows.alias("rows"),
    )
    customers = orders.groupBy("customer_id").agg(
        *[c for i, _ in numbered for c in _customer_figures(i)],
        (F.sum("total") / F.sum("rows")).alias("aov"),
    )
    return customers.select(
        "customer_id",
        *[c for i, w in numbered for c in _named(w, i, suffixes[i])],
        "aov",
    )


def rfm_features(transactions: DataFrame, window: Window) -> DataFrame:
    """One row per customer with an order up to the anchor."""
    past = transactions.filter(F.col("order_datetime") <= window.end)
    return customer_activity(past, [window]).drop("aov")


def with_attributes(
    features: DataFrame, customers: DataFrame, repeats: HeavyKeys | bool | None = None
) -> DataFrame:
    """Attach the customer attributes that exist.

    Customers without a master record keep null attributes; a customer listed twice yields
    two rows. ``repeats`` passes on customers listed very often, if an earlier pass found them.
    """
    kept = [c for c in CUSTOMER_ATTRIBUTES if c in customers.columns]
    return join_unique(features, customers.select("customer_id", *kept), "customer_id", repeats=repeats)


def active_customers(transactions: DataFrame, window: Window) -> DataFrame:
    """Distinct customers with an order inside the window, both ends included."""
    return (
        transactions.filter(window.contains(F.col("order_datetime")))
        .select("customer_id")
        .distinct()
    )
