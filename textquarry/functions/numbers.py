"""Rounding as other languages do it, and small scalar rules, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nearest(x: Column, digits: int, tie) -> Column:
    """x to the nearest multiple of 10^-digits by its exact binary value; ``tie`` chooses between the lower and upper one."""
    scale = float(10**digits)
    # x = hi + lo, halves of the mantissa, so that both products with the scale are exact
    big = x * F.lit(134217729.0)
    hi = big - (big - x)
    n = F.rint(x * scale)
    off = (hi * scale - n) + (x - hi) * scale  # how far n lies under x, sign and size exact near the middle
    up, down = F.when(off == 0.5, tie(n, n + 1)).otherwise(n + 1), F.when(off == -0.5, tie(n - 1, n)).otherwise(n - 1)
    return F.when(off >= 0.5, up).when(off <= -0.5, down).otherwise(n) / scale


def round_python(x: Column, digits: int = 2) -> Column:
    """Python's round(): the nearest decimal to the exact binary value, ties to even."""
    return _nearest(x, digits, lambda low, high: F.when(F.pmod(low, F.lit(2.0)) == 0, low).otherwise(high))


def to_fixed(x: Column, digits: int = 2) -> Column:
    """JavaScript's Number(x.toFixed(digits)): the nearest decimal to the exact binary value, ties away from zero."""
    return F.when(x < 0, -_nearest(-x, digits, lambda low, high: high)).otherwise(_nearest(x, digits, lambda low, high: high))


def round_js(x: Column) -> Column:
    """JavaScript's Math.round(): ties up."""
    return F.floor(x + F.lit(0.5))


def percent(part: Column, whole: Column) -> Column:
    """Rounded share in whole percent; 0 of nothing."""
    return F.when(whole > 0, round_js(part / whole * 100)).otherwise(F.lit(0).cast("long"))


def pages(total: Column, limit: int) -> Column:
    return F.ceil(total / F.lit(limit))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds from ``start`` to ``end``, not under 0; 0 where one is missing."""
    return F.coalesce(F.greatest(F.lit(0), F.timestamp_diff("MILLISECOND", start, end)), F.lit(0)).cast("long")


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def next_version(name: str, taken: set[str], tries: int = 100) -> str:
    """``X`` becomes ``X v2`` and ``X vN`` ``X vN+1``, until nobody has the name."""
    for _ in range(tries):
        m = re.fullmatch(r"(.*) v(\d+)", name, re.S)
        name = f"{m[1]} v{int(m[2]) + 1}" if m else f"{name} v2"
        if name not in taken:
            return name
    raise ValueError("no free name")


def next_version_column(name: Column) -> Column:
    number = F.regexp_extract(name, r"(?s)^(.*) v(\d+)$", 2).try_cast("int")
    return F.when(number.isNotNull(), F.concat(F.regexp_extract(name, r"(?s)^(.*) v(\d+)$", 1), F.lit(" v"), (number + 1).cast("string"))).otherwise(F.concat(name, F.lit(" v2")))


def least_one(value: str | int | None, default: int = 1) -> int:
    """A setting as a whole number (leading digits count); the default where it is none or under 1."""
    m = re.match(r"\s*[+-]?\d+", "" if value is None else str(value))
    return int(m[0]) if m and int(m[0]) >= 1 else default
