"""Benefit recipients in a person-month panel of survey waves.

Columns are those of the public codebook of the panel survey.  Prices have one row
per month: (month_cal, price), month 1 being January of the price base year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import floor_bin, month_index, ratio
from tallyframe.operators import panel
from tallyframe.operators.attach import first_rows
from tallyframe.operators.weights import multi_distribution, share_of_total, weighted_mean
from tallyframe.surveys import fixed_values as fixed

AMOUNTS = ["tpearn", "tfearn", "tftotinc", "tptotinc", "t05amt"]


def price_months(prices: DataFrame, day: str, price: str) -> DataFrame:
    month = month_index(F.year(day), F.month(day), fixed.PRICE_BASE_YEAR)
    return prices.select(month.alias("month_cal"), F.col(price).alias("price"))


def recipient_panel(waves: DataFrame, prices: DataFrame, price_on: str = "period_index") -> DataFrame:
    """Stacked wave rows with keys, real amounts, event flags, dates and prior income.

    The published tables match prices on the interview index; ``period_index_cal``
    matches them on the calendar month, counted from the base year of the prices.
    """
    built = panel.build_panel(
        waves,
        unit="ssuid",
        entity="eentaid",
        person="epppnum",
        address="shhadid",
        family="rfid",
        head="efrefper",
        age="tage",
        wave="swave",
        ref_month="srefmon",
        year="rhcalyr",
        month="rhcalmn",
        bad_wave=fixed.LONG_CODE_WAVE,
        base_year=fixed.CALENDAR_BASE_YEAR,
    ).withColumns(
        {"any_coll": F.col("eeducate") >= fixed.COLLEGE_CODE, "any_ba": F.col("eeducate") >= fixed.BACHELOR_CODE}
    )
    if price_on == "period_index_cal":
        years = fixed.PRICE_BASE_YEAR - fixed.CALENDAR_BASE_YEAR
        priced = built.withColumn("__price_month", F.col(price_on) - 12 * years)
        real = panel.deflate(priced, prices, "__price_month", "month_cal", "price", AMOUNTS).drop("__price_month")
    else:
        real = panel.deflate(built, prices, price_on, "month_cal", "price", AMOUNTS)
    separated = (F.col("epopstat") == 1) & (F.col("epdjbthn") == 1) & (F.col("ejobcntr") > 0) & (F.col("estlemp1") == 2)
    flagged = panel.flag_events(
        real,
        "id",
        "period_index",
        {"ui_now": F.col("t05amt") > 0, "sep": separated},
        {"sep_to_unemp": ("sep", F.col("rmesr").isin(fixed.UNEMPLOYED_CODES))},
        {"any_ui": "ui_now", "any_sep": "sep", "any_unemp": "sep_to_unemp"},
    )
    dated = panel.event_study(flagged, "id", "period_index", {"ui": "ui_now", "sep": "sep", "u": "sep_to_unemp"})
    return panel.prior_window_mean(
        dated, "id", "period_index", "first_ui_date", {"inc_prior_ui": "tpearn_adj", "incf_prior_ui": "tftotinc_adj"}
    )


def cohorts(df: DataFrame, seed: int = fixed.PLACEBO_SEED) -> DataFrame:
    """Employed (at a placebo date), unemployed and benefit-receiving cohorts."""
    drawn = panel.pseudo_event(
        df, "id", "period_index", F.col("tpearn_adj") > 0, earliest=fixed.EARLIEST_PLACEBO, seed=seed
    ).withColumn("in_pov", F.col("tftotinc") < F.col("rfpov"))
    measures = ["tpearn_adj", "tfearn_adj", "tftotinc_adj", "in_pov"]
    return panel.cohort_stack(
        drawn,
        "id",
        "period_index",
        {
            "Employed": ("pseudo_date", None),
            "Unemployed: All": ("first_u_date", F.col("any_unemp")),
            "Unemployed: Get UI": ("first_ui_date", F.col("any_ui")),
        },
        {f"{m}_prior": m for m in measures},
        keep=["id", "period_index", "wpfinwgt", "tage", *measures],
    )


def representativeness(stack: DataFrame, scaled_row: bool = False) -> DataFrame:
    """Means and median income by cohort at the start of the spell, in real money.

    ``scaled_row`` adds the recipients once more with earnings scaled to those paid
    by direct deposit; the published table has no such row.
    """
    others = F.col("tfearn_adj") - F.col("tpearn_adj")
    scaled = (
        "Unemployed: Get UI",
        "Unemployed: Get UI, Pay DD",
        fixed.PAID_BY_DEPOSIT,
        ["Person Earn", "Others' Earn", "Other Earn > 0"],
    )
    return panel.representativeness_table(
        stack,
        "period_index",
        "wpfinwgt",
        {
            "Under 21": F.col("tage") <= fixed.YOUNG_AGE,
            "Fam Inc": F.col("tftotinc_adj_prior"),
            "Poverty Rate": F.col("in_pov_prior"),
            "Fam Earn": F.col("tfearn_adj_prior"),
            "Person Earn": F.col("tpearn_adj_prior"),
            "Other Earn > 0": others > 0,
            "Others' Earn": F.col("tfearn_adj_prior") - F.col("tpearn_adj_prior"),
        },
        ("Median Fam Inc", "tftotinc_adj_prior"),
        scaled=scaled if scaled_row else None,
    )


def _recipients(df: DataFrame) -> DataFrame:
    return df.filter((F.col("first_ui_date") >= 13) & F.col("any_ui") & F.col("incf_prior_ui").isNotNull())


def mean_head_age(df: DataFrame) -> DataFrame:
    return _recipients(df).agg(weighted_mean(F.col("hfam_age"), F.col("wpfinwgt")).alias("mean_age"))


def age_distribution(df: DataFrame) -> DataFrame:
    """Weight by age bin of the family head, each family once per bin."""
    rows = _recipients(df).select("hfam_age_bin", "id_fam", "id", "period_index", "wpfinwgt")
    families = first_rows(rows, ["hfam_age_bin", "id_fam"], ["id", "period_index"])
    return share_of_total(families.groupBy("hfam_age_bin").agg(F.sum("wpfinwgt").alias("wt")), "wt")


def income_distributions(df: DataFrame) -> DataFrame:
    """Yearly family earnings and income of everybody and of recipients before
    their benefits, binned, side by side."""

    def mean(column: str) -> Column:
        # one unknown month leaves the mean unknown
        return F.when(F.count_if(F.col(column).isNull()) == 0, ratio(F.sum(column), F.count(F.lit(1))))

    def yearly(column: str) -> Column:
        return 12 * mean(column)

    def per_person(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(
            mean("wpfinwgt").alias("wt"),
            yearly("tfearn_adj").alias("earn"),
            yearly("tftotinc_adj").alias("inc"),
            (F.max("period_index") - F.min("period_index")).alias("span"),
        )

    first = F.col("first_ui_date")
    everybody = per_person(df.filter("period_index <= 12"))
    recipients = per_person(
        df.filter((F.col("period_index") >= first - 12) & (F.col("period_index") < first))
    ).filter("span = 11")

    def bins(column: str, bottom: float | None = None) -> Column:
        return floor_bin(F.col(column), fixed.INCOME_BIN, top=fixed.INCOME_TOP, bottom=bottom)

    return multi_distribution(
        [
            (everybody, "wt", {"earn": bins("earn"), "inc": bins("inc", 0)}),
            (recipients, "wt", {"earn_ui": bins("earn"), "inc_ui": bins("inc")}),
        ]
    ).orderBy("bin")
