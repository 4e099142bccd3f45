"""Exact decimal rounding of doubles, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1 cuts a double into two halves of 26 bits
_DENSE = float(2**39)  # from here on doubles are coarser than four decimals


def _scaled(a: Column, digits: int) -> Column:
    """``a * 10**digits`` as a whole number, ties to even, from the binary value.

    Built-in ``round`` works on the printed decimal (2.00005 -> 2.0001) although
    the double lies below the tie. The product is therefore compared with the tie
    in two exact halves.
    """
    scale = F.lit(float(10**digits))
    wide = a * F.lit(_SPLIT)
    high = wide - (wide - a)
    low = a - high
    whole = F.floor(a * scale).cast("double")
    over_tie = (high * scale - whole - F.lit(0.5)) + low * scale
    up = (over_tie > 0) | ((over_tie == 0) & (whole % 2 == 1))
    return whole + up.cast("double")


def round_exact(x: Column, digits: int = 4) -> Column:
    """Correctly rounded double with at most four decimals."""
    a = F.abs(x)
    return F.when(
        a < F.lit(_DENSE), F.signum(x) * (_scaled(a, digits) / F.lit(float(10**digits)))
    ).otherwise(x)


def fixed2(x: Column, signed: bool = False) -> Column:
    """Text with exactly two decimals, as C's ``%.2f`` (or ``%+.2f``)."""
    n = _scaled(F.abs(x), 2).cast("long")
    body = F.concat(
        F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0")
    )
    negative = x.cast("string").startswith("-")
    plus = "+" if signed else ""
    return F.concat(F.when(negative, F.lit("-")).otherwise(F.lit(plus)), body)


def percent(ratio: Column) -> Column:
    """0.587 -> ``58.70%``."""
    return F.concat(fixed2(ratio * F.lit(100.0)), F.lit("%"))


def percent_delta(points: Column) -> Column:
    """Percentage points with sign: -1.93 -> ``-1.93%``."""
    return F.concat(fixed2(points, signed=True), F.lit("%"))
