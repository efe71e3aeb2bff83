"""Text columns: keys, currency, percent labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def suffix_from(col: Column, first: int) -> Column:
    """The text from 1-based position ``first`` to the end."""
    return F.substr(col, F.lit(first))


def repaired_code(code: Column, wave: Column, bad_wave: int, first: int = 2) -> Column:
    """Codes of one wave carry an extra leading character; drop it there only."""
    return F.when(wave == bad_wave, suffix_from(code, first)).otherwise(code)


def pasted(*parts: Column) -> Column:
    """One key text out of several parts; a NULL part adds nothing."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def money_to_double(col: Column) -> Column:
    """``"$1,234.50 "`` to 1234.5; text that is no amount gives NULL."""
    return lenient_double(F.regexp_replace(col, "[$,]", ""))


def lenient_double(col: Column) -> Column:
    """Number out of text, NULL for markers such as ``--``."""
    return F.trim(col.cast("string")).try_cast("double")


def percent_text(share: Column) -> Column:
    """0.125 to ``"12%"``: half-even first, because formatting rounds half up."""
    return F.format_string("%.0f%%", F.bround(share * 100, 0))


def yes_no(col: Column, yes: str = "Y") -> Column:
    return F.when(col == yes, "Yes").when(col.isNotNull(), "No")
