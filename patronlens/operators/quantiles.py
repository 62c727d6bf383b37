"""Exact quantiles of large tables without gathering the values in one place.

The built-in exact percentile merges every distinct value into a single buffer. Here each
wanted rank is narrowed down to a small range of values first: a sketch of bounded size
proposes cut points close to the rank, exact counts tell between which cuts it really lies,
and this repeats until the range holds at most ``MAX_ORDERED`` rows. Only those are put in
order. The sketch never decides a result: if its guess were off, the counts would simply
point at a wider range. The driver sees a handful of numbers.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# A range shrinks about 250-fold per round at this accuracy; finer sketches cost far more.
SKETCH_ACCURACY = 1_000
MAX_ORDERED = 200_000


@dataclass(frozen=True)
class Quantile:
    """``lower`` is the value at the rank rounded down; ``value`` interpolates linearly."""

    rows: int
    lower: float
    value: float


@dataclass(frozen=True)
class _Range:
    """Values strictly between two bounds; ``before`` rows lie below, ``size`` inside."""

    column: str
    low: float | None
    high: float | None
    before: int
    size: int

    def value(self) -> Column:
        """The column's value inside the range, null outside."""
        v = F.col(self.column).cast("double")
        inside = v.isNotNull() & ~F.isnan(v)
        if self.low is not None:
            inside = inside & (v > self.low)
        if self.high is not None:
            inside = inside & (v < self.high)
        return F.when(inside, v)


def interpolate(low: float, high: float, weight: float) -> float:
    step = high - low
    return high - step * (1 - weight) if weight >= 0.5 else low + step * weight


def _cut_points(
    df: DataFrame, ranges: Mapping[_Range, set[int]], accuracy: int
) -> dict[_Range, list[float]]:
    """Values near the wanted ranks of every range, from one aggregate."""
    margin = 2.0 / accuracy
    sketches = []
    for i, (r, ranks) in enumerate(ranges.items()):
        shares = [(rank - r.before) / max(r.size - 1, 1) for rank in ranks]
        grid = sorted(
            {min(max(s + d, 0.0), 1.0) for s in shares for d in (-margin, 0.0, margin)}
        )
        sketches.append(F.percentile_approx(r.value(), grid, accuracy).alias(f"c{i}"))
    row = df.agg(*sketches).head()
    return {r: sorted(set(row[f"c{i}"])) for i, r in enumerate(ranges)}


def _narrowed(
    df: DataFrame, ranges: Mapping[_Range, set[int]], accuracy: int
) -> tuple[dict[tuple[str, int], float], dict[_Range, set[int]]]:
    """One round: ranks that fall on a cut point get their value, the others a new range."""
    cuts = _cut_points(df, ranges, accuracy)
    keys = [(r.column, cut) for r, points in cuts.items() for cut in points]
    aggregates = []
    for i, (column, cut) in enumerate(keys):
        v = F.nanvl(F.col(column).cast("double"), F.lit(None))
        aggregates += [F.count_if(v < cut).alias(f"l{i}"), F.count_if(v <= cut).alias(f"u{i}")]
    row = df.agg(*aggregates).head()
    counts = {key: (row[f"l{i}"], row[f"u{i}"]) for i, key in enumerate(keys)}

    values, rest = {}, {}
    for r, ranks in ranges.items():
        for rank in ranks:
            low, high, before, upto = r.low, r.high, r.before, r.before + r.size
            for cut in cuts[r]:
                below, including = counts[r.column, cut]
                if including <= rank:
                    low, before = cut, including
                elif below <= rank:
                    values[r.column, rank] = cut
                    break
                else:
                    high, upto = cut, below
                    break
            if (r.column, rank) not in values:
                found = _Range(r.column, low, high, before, upto - before)
                rest.setdefault(found, set()).add(rank)
    return values, rest


def _ordered_values(
    df: DataFrame, ranges: Mapping[_Range, set[int]]
) -> dict[tuple[str, int], float]:
    """Values at the wanted ranks of ranges that are small enough to be put in order."""
    numbered = list(ranges.items())
    entries, hits = [], F.lit(False)
    for i, (r, ranks) in enumerate(numbered):
        v = r.value()
        entries.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("range"), v.alias("v"))))
        for rank in ranks:
            place = rank - r.before
            hits = hits | (
                (F.col("range") == i) & (F.col("first") <= place) & (F.col("upto") > place)
            )
    in_order = W.partitionBy("range").orderBy("v")
    found = (
        df.select(F.explode(F.array(entries)).alias("e"))
        .filter(F.col("e").isNotNull())
        .groupBy("e.range", "e.v")
        .agg(F.count("*").alias("copies"))
        .withColumn("upto", F.sum("copies").over(in_order))
        .withColumn("first", F.col("upto") - F.col("copies"))
        .filter(hits)
        .collect()
    )
    values = {}
    for row in found:
        r, ranks = numbered[row["range"]]
        for rank in ranks:
            if row["first"] <= rank - r.before < row["upto"]:
                values[r.column, rank] = row["v"]
    return values


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    accuracy: int = SKETCH_ACCURACY,
    max_ordered: int = MAX_ORDERED,
) -> dict[str, dict[float, Quantile | None]]:
    """Quantiles ``{column: {fraction: Quantile}}``; None for a column without values.

    Nulls and NaN are ignored. Pass a persisted or stored table: it is read once to count, once to
    order, and twice per round of narrowing, of which there are none up to ``max_ordered``
    rows and two at ten billion.
    """
    counted = df.agg(*[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"n{i}") for i, c in enumerate(wanted)]).head()
    sizes = {c: counted[f"n{i}"] for i, c in enumerate(wanted)}

    values: dict[tuple[str, int], float] = {}
    small: dict[_Range, set[int]] = {}
    large: dict[_Range, set[int]] = {}
    for c, fractions in wanted.items():
        top = sizes[c] - 1
        ranks = {f(q * top) for q in fractions for f in (math.floor, math.ceil)}
        if top >= 0:
            start = _Range(c, None, None, 0, sizes[c])
            (small if sizes[c] <= max_ordered else large)[start] = ranks
    while large:
        found, rest = _narrowed(df, large, accuracy)
        values |= found
        large = {r: ranks for r, ranks in rest.items() if r.size > max_ordered}
        small |= {r: ranks for r, ranks in rest.items() if r.size <= max_ordered}
    if small:
        values |= _ordered_values(df, small)

    def quantile(column: str, q: float) -> Quantile | None:
        position = q * (sizes[column] - 1)
        if position < 0:
            return None
        low = values[column, math.floor(position)]
        high = values[column, math.ceil(position)]
        weight = position - math.floor(position)
        return Quantile(sizes[column], low, interpolate(low, high, weight))

    return {c: {q: quantile(c, q) for q in fractions} for c, fractions in wanted.items()}
