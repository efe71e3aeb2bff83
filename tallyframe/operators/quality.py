"""Checks that return rows, so a run can report every failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.series import unmatched_periods

CLOSE = 1e-8


def check_expected(actual: DataFrame, expected: DataFrame, name: str, shown: Column) -> DataFrame:
    """Published facts against computed ones, compared as the text a reader sees.

    ``actual`` (name, value), ``expected`` (name, expected text); ``shown`` turns
    the value into text.  A fact missing on either side fails.
    """
    both = expected.join(actual, name, "full")
    text = both.select(name, shown.alias("actual"), "expected")
    return text.withColumn("pass", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))


def check_sum_to_one(df: DataFrame, by: list[str], weight: str, tolerance: float = CLOSE) -> DataFrame:
    total = df.groupBy(*by).agg(F.sum(weight).alias("total"))
    return total.withColumn("pass", F.abs(F.col("total") - 1) < tolerance)


def check_aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many periods only one of two series has."""
    sides = unmatched_periods(a, b, keys)
    counts = sides.agg(
        F.count_if(F.col("only_in") == "left").alias("only_left"),
        F.count_if(F.col("only_in") == "right").alias("only_right"),
    )
    return counts.withColumn("pass", (F.col("only_left") == 0) & (F.col("only_right") == 0))
