"""What has to be known before an analysis can be planned, from one job over both tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from patronlens.fixed_values import DEFAULT_DAYS, NO_DATE_ERROR
from patronlens.operators.anchor import Window, check_days, reporting_window, survey
from patronlens.operators.clean import clean_bundle, clean_transactions
from patronlens.operators.heavy import HeavyKeys, heavy_keys, known_heavy, summary
from patronlens.operators.layouts import chosen_layout, latest_read, layout_votes
from patronlens.sources.bundle import TableBundle

ORDER_DATE, CREATED = "order_datetime", "account_creation_date"


@dataclass(frozen=True)
class FirstLook:
    """Cleaned tables, the window, and customers that are listed very often (None: not looked for)."""

    bundle: TableBundle
    window: Window
    often: HeavyKeys | None
    layouts: dict[str, tuple[str, ...]]


def _is_text(df: DataFrame, column: str) -> bool:
    return column in df.columns and isinstance(df.schema[column].dataType, StringType)


def _usable(transactions: DataFrame) -> DataFrame:
    """The date texts of rows that lack nothing else."""
    any_date = F.lit("1970-01-01").cast("timestamp_ntz")
    given = transactions.filter(F.col(ORDER_DATE).isNotNull()).withColumn("_text", F.col(ORDER_DATE))
    return clean_transactions(given.withColumn(ORDER_DATE, any_date)).select(F.col("_text").alias(ORDER_DATE))


def first_look(
    bundle: TableBundle,
    days: int = DEFAULT_DAYS,
    at: date | str | None = None,
    date_formats: Sequence[str] | None = None,
) -> FirstLook:
    """Clean the tables and find the window.

    Where dates are text and no layouts are named, all known layouts vote in the aggregate that also
    finds the latest date, so that takes no further pass. Naming layouts, even none, skips the vote.
    """
    days = check_days(days)
    transactions, customers = bundle.transactions, bundle.customers
    columns = {name: df for name, df in ((ORDER_DATE, transactions), (CREATED, customers)) if _is_text(df, name)}
    if date_formats is not None or not columns:
        cleaned = clean_bundle(bundle, date_formats or ())
        window, often = survey(cleaned.transactions, cleaned.customers, days, at)
        return FirstLook(cleaned, window, often, {})

    aggregates = []
    known = customers.filter(F.col("customer_id").isNotNull())
    counted = known.agg(
        summary("customer_id").alias("counters"), F.count("*").alias("rows"),
        *([layout_votes(CREATED)] if CREATED in columns else []),
    )
    heavy = heavy_keys(F.col("counters"), F.col("rows")).alias("heavy")
    aggregates.append(counted.select(F.lit(CREATED).alias("column"), heavy, *(["votes"] if CREATED in columns else [])))
    if ORDER_DATE in columns:
        votes = _usable(transactions).agg(layout_votes(ORDER_DATE))
        aggregates.append(votes.select(F.lit(ORDER_DATE).alias("column"), "votes"))
    both = aggregates[0]
    for more in aggregates[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    rows = {r["column"]: r.asDict() for r in both.collect()}
    often = known_heavy(rows[CREATED]["heavy"])
    layouts = {name: chosen_layout(name, rows[name]["votes"]) for name in columns}
    cleaned = clean_bundle(bundle, layouts.get(ORDER_DATE, ()), layouts.get(CREATED, ()))
    if at is not None or ORDER_DATE not in columns:
        return FirstLook(cleaned, reporting_window(cleaned.transactions, days, at), often, layouts)
    latest = latest_read(rows[ORDER_DATE]["votes"])
    if latest is None:
        raise ValueError(NO_DATE_ERROR)
    return FirstLook(cleaned, Window(datetime(latest.year, latest.month, latest.day), days), often, layouts)
