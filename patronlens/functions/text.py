"""Fixed-point text whose rounding looks at the exact binary value of the double.

``format_string`` rounds the shortest decimal form half up, so 0.15 prints as 0.2 and
12.5 as 13. ``format_number`` decides on the stored value instead (0.15 lies slightly below
the tie) and takes exact ties to the even digit, like C-style formatting.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed_text(value: Column, digits: int, ties: str = "even") -> Column:
    """Text with exactly ``digits`` decimals and no thousands separators.

    ``ties='even'`` matches C-style formatting, ``ties='up'`` takes exact ties of
    non-negative values upwards. A double is an exact tie only as an odd multiple of
    2^-(digits + 1), since no other tie has a finite binary form.
    """
    if ties == "up":
        halves = value * float(2 ** (digits + 1))
        is_tie = (halves == F.floor(halves)) & (F.pmod(halves, F.lit(2.0)) == 1.0)
        value = F.when(is_tie, value + 2.0 ** -(digits + 3)).otherwise(value)
    pattern = "0." + "0" * digits if digits else "0"
    text = F.call_function("format_number", value, F.lit(pattern))
    # The formatter misjudges the double next to half a unit when no digit precedes it.
    half_unit = float(f"5e-{digits + 1}")
    return F.when(value == half_unit, f"{half_unit:.{digits}f}").otherwise(text)


def percent_text(share: Column, digits: int, ties: str = "even") -> Column:
    """A share in [0, 1] as percent digits, without the percent sign."""
    return fixed_text(share * 100, digits, ties)


def grouped_whole(value: Column) -> Column:
    """Rounded to a whole number (ties towards +infinity) with thousands separators."""
    down = F.floor(value)
    return F.format_number(F.when(value - down >= 0.5, down + 1).otherwise(down), 0)
