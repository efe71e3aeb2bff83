"""Numeric columns: bins, ratios, month arithmetic, utility, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.96
BAND_WIDTH_95 = 3.92


def floor_bin(x: Column, width: float, top: float | None = None, bottom: float | None = None) -> Column:
    """Lower edge of the bin of ``x``; ``top`` is the open last bin, ``bottom`` the
    bin that takes everything below it."""
    edge = F.floor(x / F.lit(float(width))).cast("double") * F.lit(float(width))
    if top is not None:
        edge = F.when(x < top, edge).when(x.isNotNull(), F.lit(float(top)))
    if bottom is not None:
        edge = F.when(x < bottom, F.lit(float(bottom))).otherwise(edge)
    return edge


def capped(x: Column, most: int) -> Column:
    return F.when(x < most, x).when(x.isNotNull(), F.lit(most))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL when ``b`` is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def month_index(year: Column, month: Column, base_year: int) -> Column:
    """1 for January of the base year."""
    return ((year - base_year) * 12 + month).cast("int")


def wave_month_index(wave: Column, ref_month: Column, months_per_wave: int = 4) -> Column:
    """1 for the first reference month of wave 1."""
    return ((wave - 1) * months_per_wave + ref_month).cast("int")


def wave_of(period: Column, months_per_wave: int = 4) -> Column:
    return (F.floor(period / months_per_wave) + 1).cast("int")


def wave_start(offset: Column, months_per_wave: int = 4) -> Column:
    """Relative month rounded down to a whole wave."""
    return (F.floor(offset / months_per_wave) * months_per_wave).cast("int")


def isoelastic(c: Column, rho: float) -> Column:
    return F.pow(c, F.lit(1.0 - rho)) / (1.0 - rho)


def marginal_isoelastic(c: Column, rho: float) -> Column:
    return F.pow(c, F.lit(-rho))


def effort_cost(s: Column, k: float, phi: float) -> Column:
    return k * F.pow(s, F.lit(1.0 + phi)) / (1.0 + phi)


def band(value: Column, se: Column) -> tuple[Column, Column]:
    """Lower and upper end of the 95% confidence band."""
    return value - Z_95 * se, value + Z_95 * se


def se_from_band(low: Column, high: Column) -> Column:
    return (high - low) / BAND_WIDTH_95


def hashed_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
