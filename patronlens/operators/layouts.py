"""Date layouts of text columns, found by a vote of all candidates over the column.

Every candidate counts the values that it can read, in one aggregate; the layout that reads most is taken
for the column, and what it cannot read is no date. ISO text needs no vote. If two layouts read equally
many values but give different days, the column is ambiguous, which is an error: state the
layout then. Values are first compared with the shape of a layout, so a column in ISO form costs next
to nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from patronlens.functions.parsing import parse_timestamp

_TIME = r"( \d{1,2}:\d{2}(:\d{2})?( [AaPp][Mm])?)?$"
_CLOCK = "[ h:mm[:ss] a][ H:mm[:ss]]"
# The layouts that are tried, each with the shape of its text before the time of day.
CANDIDATES = {
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}",
    "d/M/yy": r"^\d{1,2}/\d{1,2}/\d{2}",
    "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}",
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}",
    "d.M.yy": r"^\d{1,2}\.\d{1,2}\.\d{2}",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}",
    "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}",
}
NAMES = list(CANDIDATES)
RIVALS = [
    (i, j) for i, a in enumerate(NAMES) for j, b in enumerate(NAMES) if i < j and CANDIDATES[a] == CANDIDATES[b]
]


def full_layout(name: str) -> str:
    """A layout with an optional time of day."""
    return name + _CLOCK


def layout_votes(column: str) -> Column:
    """An aggregate of a text column: what ISO and each candidate read, the latest of it, and in how many
    values rivals of one shape differ, be it that one of them reads nothing."""
    text = F.trim(F.col(column))
    iso = parse_timestamp(F.col(column), StringType())

    def read(name: str) -> Column:
        fits = iso.isNull() & text.rlike(CANDIDATES[name] + _TIME)
        return F.when(fits, F.try_to_timestamp(text, F.lit(full_layout(name))).cast("timestamp_ntz"))

    values = [read(name) for name in NAMES]
    return F.struct(
        F.max(iso).alias("iso"),
        F.array(*[F.count(v) for v in values]).alias("n"),
        F.array(*[F.max(v) for v in values]).alias("latest"),
        F.array(*[F.count_if(~values[i].eqNullSafe(values[j])) for i, j in RIVALS]).alias("differ"),
    ).alias("votes")


def chosen_layout(column: str, votes: Mapping) -> tuple[str, ...]:
    """The layout that reads most values, as a list for the cleaning step; none for ISO columns."""
    best = max(votes["n"])
    if not best:
        return ()
    first, *others = [i for i, n in enumerate(votes["n"]) if n == best]
    for other in others:
        if (first, other) not in RIVALS or votes["differ"][RIVALS.index((first, other))]:
            raise ValueError(
                f"dates in {column} are ambiguous: {NAMES[first]} and {NAMES[other]} read {best} values each; "
                "name the layout in date_formats"
            )
    return (full_layout(NAMES[first]),)


def latest_read(votes: Mapping) -> datetime | None:
    """The latest date under ISO and the layout that was chosen."""
    best = max(votes["n"])
    found = [votes["iso"], votes["latest"][votes["n"].index(best)] if best else None]
    return max((moment for moment in found if moment is not None), default=None)


def infer_layouts(df: DataFrame, column: str) -> tuple[str, ...]:
    """The layout of a text column from one aggregate over it; other types need none."""
    if column not in df.columns or not isinstance(df.schema[column].dataType, StringType):
        return ()
    return chosen_layout(column, df.agg(layout_votes(column)).head()[0])
