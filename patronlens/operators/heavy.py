"""Keys with a large share of the rows, from a summary that other aggregates fill on their way.

The summary keeps counters for a fixed number of keys (frequent items, mergeable), so it is a partial
aggregate like a sum: no rows are shuffled, and it needs no job of its own where an aggregate of the
same table runs anyway. Counts are exact as long as the counters suffice for all keys, and else short by
less than a 250th of the rows; a key missed or listed too many changes how rows are dealt out, never a result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

HOT_SHARE = 1 / 64
COUNTERS = 1024


@dataclass(frozen=True)
class HeavyKeys:
    """Keys found in an earlier pass; fewer than ``1 / HOT_SHARE`` at any size of the table."""

    keys: tuple

    def column(self, dtype: str) -> Column:
        return F.array(*[F.lit(k) for k in self.keys]).cast(f"array<{dtype}>")


def summary(key: str) -> Column:
    """Mergeable counters of a column, as an aggregate."""
    return F.call_function("approx_top_k_accumulate", F.col(key), F.lit(COUNTERS))


def merged_summary(summaries: str) -> Column:
    """One summary from a column of them, for tables that are kept in parts."""
    return F.call_function("approx_top_k_combine", F.col(summaries), F.lit(COUNTERS))


def heavy_keys(counters: Column, rows: Column, share: float = HOT_SHARE) -> Column:
    """The array of keys with more than ``share`` of the rows, nulls left out."""
    found = F.call_function("approx_top_k_estimate", counters, F.lit(COUNTERS // 8))
    large = F.filter(found, lambda x: x["item"].isNotNull() & (x["count"] > rows * share))
    return F.transform(large, lambda x: x["item"])


def heavy_key_row(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """One row ``heavy``, an array of keys; reads the key column alone."""
    rows = df.select(key).agg(summary(key).alias("counters"), F.count("*").alias("rows"))
    return rows.select(heavy_keys(F.col("counters"), F.col("rows"), share).alias("heavy"))


def known_heavy(values: Sequence | None) -> HeavyKeys:
    return HeavyKeys(tuple(values or ()))
