"""Short series held in one array cell (moment vectors), at the edge only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(series: Column, start: int | Column, length: int | Column) -> Column:
    """``length`` values from 0-based position ``start``."""
    first = start + 1 if isinstance(start, int) else start + F.lit(1)
    return F.slice(series, first, length)


def padded_front(series: Column, length: Column) -> Column:
    """NULLs in front until the array has ``length`` values."""
    missing = F.greatest(length - F.size(series), F.lit(0))
    return F.concat(F.array_repeat(F.lit(None).cast("double"), missing), series)


def normalised(series: Column, at: int) -> Column:
    """Every value over the value at 0-based position ``at``."""
    base = F.get(series, F.lit(at))
    return F.transform(series, lambda v: F.try_divide(v, base))
