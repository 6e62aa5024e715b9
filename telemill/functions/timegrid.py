"""Epoch arithmetic on a regular time grid.

Grid times are multiples of the step since the epoch. A window of width ``d`` that is evaluated at
``t`` covers ``(t - d, t]``. All arithmetic is on BIGINT microseconds, so it is exact.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}


def micros(width: str | int | dt.timedelta) -> int:
    """``"2 minutes"``, a timedelta or a number of seconds, as microseconds."""
    if isinstance(width, dt.timedelta):
        return round(width.total_seconds() * 10**6)
    if isinstance(width, (int, float)):
        return round(width * 10**6)
    words = width.split()
    total = sum(int(n) * MICROS[unit.rstrip("s")] for n, unit in zip(words[::2], words[1::2], strict=True))
    if total <= 0:
        raise ValueError(f"width must be positive: {width!r}")
    return total


def epoch_us(col: str | Column) -> Column:
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def at(us: Column) -> Column:
    return F.timestamp_micros(us)


def ceil_to(us: Column, width: int) -> Column:
    """Smallest multiple of ``width`` that is not below ``us``."""
    return us + F.pmod(-us, F.lit(width))


def floor_to(us: Column, width: int) -> Column:
    return us - F.pmod(us, F.lit(width))


def block_of(us: Column, width: int) -> Column:
    """Number of the block ``(b * width, (b + 1) * width]`` that holds ``us``."""
    return ((ceil_to(us, width)) / F.lit(width)).cast("bigint") - 1


def grid(first: Column, last: Column, step: int) -> Column:
    """Multiples of ``step`` from ``first`` to ``last``; an empty array when there are none."""
    lo, hi = ceil_to(first, step), floor_to(last, step)
    return F.when(lo <= hi, F.sequence(lo, hi, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
