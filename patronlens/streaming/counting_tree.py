"""Counting trees of the values that segment limits are ranks of.

A tree has two levels: leaves that cover ranges of values and hold (value, n) rows, and above them, kept
in the state's manifest, the bound and the number of rows of each leaf. A rank is found from the numbers,
and its value from one leaf. Changes are added to and taken from the leaves they fall into, and only
these are written anew. Bounds come from a sketch when a tree is built; it is built again, from
the features, when a leaf has outgrown four times the values that it was laid out for.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from patronlens.fixed_values import HIGH_QUANTILE, MID_QUANTILE
from patronlens.functions.dates import epoch_seconds, whole_days_between
from patronlens.operators.anchor import Window
from patronlens.operators.quantiles import interpolate
from patronlens.operators.segments import Thresholds

LEAF_VALUES = 50_000


@dataclass(frozen=True)
class Leaf:
    """Values from ``low`` to the low of the next leaf; ``n`` rows, in the folder of batch ``version``."""

    field: str
    id: int
    low: float
    n: int
    version: int

    @property
    def path(self) -> str:
        return f"leaves/batch={self.version}/field={self.field}/leaf={self.id}"


Leaves = dict[str, tuple[Leaf, ...]]


def _values() -> dict[str, Column]:
    """The ranked values as doubles; ages of customers rank like their last orders, backwards."""
    return {
        "monetary": F.col("monetary").cast("double"),
        "frequency": F.col("frequency").cast("double"),
        "last_order": (epoch_seconds(F.col("last_order")) * 1_000_000).cast("double"),
    }


def from_rows(rows: Sequence) -> Leaves:
    found: dict[str, list[Leaf]] = {}
    for r in sorted(rows, key=lambda r: (r["field"], r["id"])):
        found.setdefault(r["field"], []).append(Leaf(r["field"], r["id"], r["low"], r["n"], r["version"]))
    return {field: tuple(leaves) for field, leaves in found.items()}


def to_rows(leaves: Leaves) -> list[tuple]:
    return [("leaf", x.field, x.id, x.low, x.n, x.version, None) for one in leaves.values() for x in one]


def _entries(rows: DataFrame, weight: int) -> DataFrame:
    """(field, value, n) for feature rows that count."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in _values().items()])
    counted = rows.filter("frequency > 0").select(F.explode(each).alias("e"))
    return counted.select("e.field", "e.value", F.lit(weight).cast("long").alias("n")).filter("value IS NOT NULL AND NOT isnan(value)")


def _placed(entries: DataFrame, lows: dict[str, list[float]]) -> DataFrame:
    """Add the leaf of each value, by binary search over the bounds of its field."""
    parts = []
    for field, bounds in lows.items():
        part = entries.filter(F.col("field") == field)
        if len(bounds) == 1:
            parts.append(part.withColumn("leaf", F.lit(0)))
            continue
        splits = [-math.inf, *bounds[1:], math.inf]
        found = Bucketizer(splits=splits, inputCol="value", outputCol="place").transform(part)
        parts.append(found.withColumn("leaf", F.col("place").cast("int")).drop("place"))
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    return placed


def _write(spark: SparkSession, folder: str, number: int, placed: DataFrame, lows: dict[str, list[float]]) -> dict[tuple[str, int], tuple[Leaf, int]]:
    """Write leaves whole; each with its number of different values."""
    total = placed.groupBy("field", "leaf", "value").agg(F.sum("n").alias("n"))
    wrong = F.when(F.col("n") < 0, F.raise_error(F.lit("a value was taken from a tree that does not hold it")))
    total = total.withColumn("n", F.coalesce(wrong.cast("long"), "n")).filter("n > 0")
    path = f"{folder}/leaves/batch={number}"
    total.repartition("field", "leaf").write.mode("overwrite").partitionBy("field", "leaf").parquet(path)
    schema = "value double, n long, field string, leaf int"
    counts = spark.read.schema(schema).parquet(path).groupBy("field", "leaf").agg(
        F.sum("n").alias("n"), F.count("*").alias("values")
    )
    return {
        (r["field"], r["leaf"]): (Leaf(r["field"], r["leaf"], lows[r["field"]][r["leaf"]], r["n"], number), r["values"])
        for r in counts.collect()
    }


def _built(spark: SparkSession, folder: str, number: int, features: DataFrame, leaf_values: int) -> tuple[Leaves, int]:
    """New trees over all features."""
    entries = _entries(features, 1)
    sizes = {r["field"]: r["n"] for r in entries.groupBy("field").agg(F.approx_count_distinct("value").alias("n")).collect()}
    lows = {}
    for field, n in sizes.items():
        wanted = -(-n // leaf_values)
        grid = [i / wanted for i in range(1, wanted)]
        values = entries.filter(F.col("field") == field)
        cuts = values.agg(F.percentile_approx("value", grid, max(1000, 4 * wanted))).head()[0] if grid else []
        lows[field] = [-math.inf, *sorted(set(cuts))]
    if not lows:
        return {}, 0
    made = _write(spark, folder, number, _placed(entries, lows), lows)
    leaves = {
        field: tuple(made[field, i][0] if (field, i) in made else Leaf(field, i, low, 0, number) for i, low in enumerate(bounds))
        for field, bounds in lows.items()
    }
    return leaves, sum(map(len, leaves.values()))


def update(
    spark: SparkSession, folder: str, number: int, before: Leaves, changed: DataFrame,
    all_features: Callable[[], DataFrame], leaf_values: int,
) -> tuple[Leaves, int]:
    """The trees after a batch, and how many leaves it has written.

    ``changed`` holds old and new figures of customers; all features are read only to build trees.
    """
    if not before:
        return _built(spark, folder, number, all_features(), leaf_values)
    lows = {field: [leaf.low for leaf in leaves] for field, leaves in before.items()}
    moved = _entries(changed.select("new.*"), 1).unionByName(_entries(changed.select("old.*"), -1))
    moved = moved.groupBy("field", "value").agg(F.sum("n").alias("n")).filter("n <> 0")
    moved = _placed(moved, lows).persist()
    try:
        touched = {(r["field"], r["leaf"]) for r in moved.select("field", "leaf").distinct().collect()}
        if not touched:
            return before, 0
        held = _read(spark, folder, [leaf for leaves in before.values() for leaf in leaves if (leaf.field, leaf.id) in touched])
        made = _write(spark, folder, number, held.unionByName(moved.select(*held.columns)), lows)
    finally:
        moved.unpersist()
    if max((values for _, values in made.values()), default=0) > 4 * leaf_values:
        return _built(spark, folder, number, all_features(), leaf_values)
    after = {}
    for field, leaves in before.items():
        emptied = [Leaf(x.field, x.id, x.low, 0, number) if (x.field, x.id) in touched else x for x in leaves]
        after[field] = tuple(made[x.field, x.id][0] if (x.field, x.id) in made else x for x in emptied)
    return after, len(touched)


def _read(spark: SparkSession, folder: str, leaves: Sequence[Leaf]) -> DataFrame:
    """(field, leaf, value, n) of these leaves; empty ones have no files."""
    found = spark.createDataFrame([], "field string, leaf int, value double, n long")
    for version in sorted({x.version for x in leaves if x.n}):
        paths = [f"{folder}/{x.path}" for x in leaves if x.n and x.version == version]
        base = spark.read.schema("value double, n long, field string, leaf int").option("basePath", f"{folder}/leaves/batch={version}")
        found = found.unionByName(base.parquet(*paths))
    return found


def values_at(spark: SparkSession, folder: str, leaves: Leaves, wanted: dict[str, Sequence[int]]) -> dict[tuple[str, int], float]:
    """The values at ranks (from 0) of fields, read from the leaves that hold them."""
    chosen: dict[tuple[str, int], list[int]] = {}
    for field, ranks in wanted.items():
        upto, ends = 0, []
        for leaf in leaves[field]:
            upto += leaf.n
            ends.append(upto)
        for rank in ranks:
            at = bisect_right(ends, rank)
            chosen.setdefault((field, at), []).append(rank - (ends[at - 1] if at else 0))
    held = _read(spark, folder, [leaves[field][at] for field, at in chosen])
    order = W.partitionBy("field", "leaf").orderBy("value")
    placed = held.withColumn("upto", F.sum("n").over(order)).withColumn("first", F.col("upto") - F.col("n"))
    hits = F.lit(False)
    for (field, at), places in chosen.items():
        for place in places:
            hits = hits | ((F.col("field") == field) & (F.col("leaf") == at) & (F.col("first") <= place) & (F.col("upto") > place))
    rows = placed.filter(hits).collect()
    found = {}
    for (field, at), places in chosen.items():
        before = sum(leaf.n for leaf in leaves[field][:at])
        for place in places:
            found[field, before + place] = next(
                r["value"] for r in rows if (r["field"], r["leaf"]) == (field, at) and r["first"] <= place < r["upto"]
            )
    return found


def thresholds(spark: SparkSession, folder: str, leaves: Leaves, window: Window | None) -> Thresholds:
    """The four segment limits, interpolated as quantiles of all feature rows."""
    if not leaves or window is None:
        return Thresholds(None, None, None, None)
    sizes = {field: sum(leaf.n for leaf in one) for field, one in leaves.items()}
    # An age at some rank is that of the last order at the same rank from the end.
    limits = [("monetary", HIGH_QUANTILE), ("frequency", HIGH_QUANTILE), ("last_order", MID_QUANTILE), ("last_order", HIGH_QUANTILE)]
    places: list[tuple[str, list[int], float] | None] = []
    wanted: dict[str, set[int]] = {}
    for field, q in limits:
        n = sizes.get(field, 0)
        position = q * (n - 1)
        ranks = [math.floor(position), math.ceil(position)]
        ranks = [n - 1 - r for r in ranks] if field == "last_order" else ranks
        places.append((field, ranks, position - math.floor(position)) if n else None)
        if n:
            wanted.setdefault(field, set()).update(ranks)
    found = values_at(spark, folder, leaves, {field: sorted(ranks) for field, ranks in wanted.items()})
    found |= _ages(spark, {key: v for key, v in found.items() if key[0] == "last_order"}, window)
    results = []
    for place in places:
        if place is None:
            results.append(None)
        else:
            field, ranks, weight = place
            results.append(interpolate(*(found[field, r] for r in ranks), weight))
    return Thresholds(*results)


def _ages(spark: SparkSession, moments: dict[tuple[str, int], float], window: Window) -> dict[tuple[str, int], float]:
    """Whole days from a few last orders to the anchor, by the rule that features follow."""
    rows = [(*key, datetime(1970, 1, 1) + timedelta(microseconds=int(v))) for key, v in moments.items()]
    table = spark.createDataFrame(rows, "field string, rank long, moment timestamp_ntz")
    age = whole_days_between(F.col("moment"), window.end).cast("double").alias("age")
    return {(r["field"], r["rank"]): r["age"] for r in table.select("field", "rank", age).collect()}
