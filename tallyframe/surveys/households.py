"""Household cross-section: bank accounts, cards, payroll deposit, liquid assets.

Columns are those of the public survey codebook: the detail file has Y1 (case),
X-numbered answers; the summary file has ready-made measures and the weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import ratio
from tallyframe.functions.text import percent_text
from tallyframe.operators import quality, weights
from tallyframe.operators.reshape import literal_table
from tallyframe.surveys import fixed_values as fixed


def households(detail: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per household with the measures the facts need."""
    cards = F.col("X411") + F.col("X419") + F.col("X425") + F.col("X428")
    answers = detail.select(
        F.col("Y1").alias("caseid"),
        F.coalesce("X3506", F.lit(0)).cast("double").alias("checking_balance"),
        (F.col("X5715") == 1).alias("claimant"),
        ((F.col("X4106") == 1) | (F.col("X4706") == 1)).alias("employee"),
        F.col("X7123").alias("deposit_code"),
        (F.col("X410") == 1).alias("any_card"),
        (cards == 1).alias("one_card"),
        (cards > 1).alias("more_cards"),
    )
    measures = summary.select(F.col("Y1").alias("caseid"), "wgt", "wageinc", "nochk", "liq")
    joined = measures.join(answers, "caseid")
    deposit = F.coalesce(F.col("deposit_code") == 1, F.lit(False))
    return joined.select(
        "*",
        F.when(F.col("nochk") != 1, deposit).alias("payroll_deposit"),
        (F.col("employee") & (F.col("wageinc") > fixed.LOWEST_BASE_WAGE)).alias("base_sample"),
    ).drop("deposit_code")


def household_facts(df: DataFrame) -> DataFrame:
    """(fact, value) for the six published statements, in one pass."""
    banked = F.col("claimant") & (F.col("nochk") == 0)
    row = weights.survey_facts(
        df,
        "wgt",
        {
            "payroll_deposit": (F.col("base_sample"), F.col("payroll_deposit"), False),
            "claimants_with_account": (F.col("claimant"), F.col("nochk"), True),
            "claimants_with_card": (banked, F.col("any_card"), False),
            "claimants_with_one_card": (banked, F.col("one_card"), False),
            "claimants_with_more_cards": (banked, F.col("more_cards"), False),
        },
        derived={
            "claimants_with_outside_card": F.col("claimants_with_one_card")
            * (1 - ratio(F.lit(fixed.OWN_BANK_CARD_SHARE), F.col("claimants_with_card")))
            + F.col("claimants_with_more_cards")
        },
    )
    return weights.facts_long(row)


def published_facts(facts: DataFrame) -> DataFrame:
    """The facts next to their published texts."""
    expected = literal_table(facts.sparkSession, ["fact", "expected"], list(fixed.HOUSEHOLD_FACTS.items()))
    return quality.check_expected(facts, expected, "fact", percent_text(F.col("value")))


def checking_distribution(df: DataFrame) -> DataFrame:
    kept = df.filter(F.col("base_sample") & (F.col("nochk") == 0) & (F.col("checking_balance") >= 0))
    return weights.binned_distribution(kept, "checking_balance", "wgt", fixed.BALANCE_BIN, top=fixed.BALANCE_TOP).orderBy("bin")


def liquid_assets(df: DataFrame) -> DataFrame:
    kept = df.filter(F.col("base_sample") & (F.col("nochk") == 0)).select(
        "wgt", F.col("liq").cast("double").alias("liquid_assets"), "checking_balance"
    )
    return weights.weighted_summary(kept, "wgt", ["liquid_assets", "checking_balance"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def short_duration_share(states: DataFrame) -> DataFrame:
    """Mean over states of the share with short potential duration of benefits."""
    short = sum((F.col(f"`{c}`") for c in fixed.SHORT_DURATION_COLUMNS[1:]), F.col(f"`{fixed.SHORT_DURATION_COLUMNS[0]}`"))
    return states.agg(F.avg(ratio(short, F.col("`Total Potential`"))).alias("share"))
