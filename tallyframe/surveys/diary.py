"""Payment diary: spending by category, and durability by payment method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import crosswalk, reshape
from tallyframe.surveys import fixed_values as fixed


def october(diary: DataFrame) -> DataFrame:
    """The study month, without the amount of one influential outlier."""
    day = F.to_date("date", "M/d/yyyy")
    amount = F.nullif(F.col("amnt"), F.lit(float(fixed.DIARY_OUTLIER)))
    return diary.filter(F.month(day) == fixed.DIARY_MONTH).select(
        "prim_key", "ind_weight", "diary_day", "pi", "merch", amount.alias("amnt")
    )


def category_shares(diary: DataFrame) -> DataFrame:
    return crosswalk.category_share(
        october(diary),
        level=reshape.collapsed(F.col("merch"), fixed.DIARY_CATEGORIES),
        amount="amnt",
        weight="ind_weight",
        scale=fixed.PEOPLE_PER_HOUSEHOLD,
        levels=list(fixed.DIARY_CATEGORIES),
    )


def durability_by_payment(diary: DataFrame) -> DataFrame:
    """Percent texts of nondurable, durable, consumption and other spending."""
    return crosswalk.payment_mix(
        october(diary),
        person="prim_key",
        day="diary_day",
        amount="amnt",
        weight="ind_weight",
        payment=reshape.collapsed(F.col("pi"), fixed.PAYMENTS),
        category=reshape.collapsed(F.col("merch"), fixed.DURABILITY),
        payment_levels=list(fixed.PAYMENTS),
        category_levels=list(fixed.DURABILITY),
        nondurable=["strict", "nondurable"],
        durable=["durable"],
        base=fixed.CONSUMPTION_KINDS,
        scale=fixed.PEOPLE_PER_HOUSEHOLD,
    )
