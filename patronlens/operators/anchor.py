"""The reporting window, anchored to the data instead of to today."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from patronlens.fixed_values import (
    DEFAULT_DAYS,
    MAX_DAYS,
    MIN_DAYS,
    NO_DATE_ERROR,
    TRAILING_DAYS,
)
from patronlens.functions.dates import midnight
from patronlens.operators.heavy import HeavyKeys, heavy_key_row, known_heavy


def _literal(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


@dataclass(frozen=True)
class Window:
    """The ``days`` before ``anchor``, as constants that filters can push to the scan."""

    anchor: datetime
    days: int

    @property
    def end(self) -> Column:
        return _literal(self.anchor)

    @property
    def start(self) -> Column:
        return _literal(self.anchor - timedelta(days=self.days))

    @property
    def since(self) -> Column:
        """Start of the trailing window of the recent-activity features."""
        return _literal(self.anchor - timedelta(days=TRAILING_DAYS))

    def contains(self, ts: Column) -> Column:
        return ts.between(self.start, self.end)


def check_days(days: int) -> int:
    if not MIN_DAYS <= int(days) <= MAX_DAYS:
        raise ValueError(f"days must lie between {MIN_DAYS} and {MAX_DAYS}, not {days}")
    return int(days)


def latest_day(df: DataFrame, ts: str = "order_datetime") -> DataFrame:
    """One row ``end``: midnight of the day of the latest timestamp, null without any."""
    return df.agg(F.max(ts).alias("latest")).select(midnight(F.col("latest")).alias("end"))


def find_anchor(
    df: DataFrame, ts: str = "order_datetime", at: date | str | None = None
) -> datetime:
    """The anchor as a value: one aggregate over the dates, or none if ``at`` gives it."""
    if at is not None:
        return datetime.combine(date.fromisoformat(str(at)[:10]), time())
    anchor = latest_day(df, ts).head()[0]
    if anchor is None:
        raise ValueError(NO_DATE_ERROR)
    return anchor


def survey(
    transactions: DataFrame, customers: DataFrame, days: int = DEFAULT_DAYS, at: date | str | None = None
) -> tuple[Window, HeavyKeys | None]:
    """The window, and the customers listed very often in ``customers``, in one job over both tables.

    Where the anchor is given no job runs, and the second part is None: not known.
    """
    if at is not None:
        return reporting_window(transactions, days, at), None
    days = check_days(days)
    latest = latest_day(transactions).select("end", F.lit(None).alias("heavy"))
    often = heavy_key_row(customers, "customer_id").select(F.lit(None).alias("end"), "heavy")
    anchor, heavy = None, None
    for row in latest.unionByName(often).collect():
        anchor, heavy = row["end"] or anchor, row["heavy"] if row["heavy"] is not None else heavy
    if anchor is None:
        raise ValueError(NO_DATE_ERROR)
    return Window(anchor, days), known_heavy(heavy)


def reporting_window(
    transactions: DataFrame,
    days: int = DEFAULT_DAYS,
    at: date | str | None = None,
    back: int = 0,
) -> Window:
    """The window of ``days`` before the anchor; ``back`` moves the anchor into the past."""
    days = check_days(days)
    return Window(find_anchor(transactions, at=at) - timedelta(days=back), days)


def window_frame(transactions: DataFrame, days: int = DEFAULT_DAYS) -> DataFrame:
    """The window bounds as one row (start, end)."""
    days = check_days(days)
    return latest_day(transactions).select(
        (F.col("end") - F.make_dt_interval(F.lit(days))).alias("start"), "end"
    )
