"""Bank spending by category against an expenditure survey and national accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import ratio
from tallyframe.operators import crosswalk, reshape
from tallyframe.operators.attach import first_rows
from tallyframe.surveys import fixed_values as fixed


def code_labels(codes: DataFrame, order: str) -> DataFrame:
    """(mcc, mcc_merchant_type): the first description of each code, one row per code."""
    named = codes.select(F.col("mcc_code").alias("mcc"), F.col("edited_description").alias("mcc_merchant_type"), order)
    return first_rows(named, ["mcc"], [order, "mcc_merchant_type"]).select("mcc", "mcc_merchant_type")


def matched_codes(transactions: DataFrame, labels: DataFrame, group: str) -> DataFrame:
    """Card spending per merchant code and customer month, with a description;
    ``group`` names the column of the bank's merchant groups."""
    return crosswalk.code_spend(
        transactions.withColumnRenamed("at_mcccode", "mcc"),
        labels,
        code="mcc",
        dollars="dollars",
        group=group,
        label="mcc_merchant_type",
        customer_months=fixed.CUSTOMER_MONTHS,
        excluded=[fixed.CASH_CODE],
    )


def other_payments(transactions: DataFrame) -> DataFrame:
    """(source, amount) of bills paid from the account rather than by card."""
    names = {
        fixed.TELECOM_PAYMENT: "telecom",
        fixed.UTILITY_PAYMENT: "utilities",
        fixed.INSURANCE_PAYMENT: "insurance",
    }
    name = reshape.recoded(F.col("at_categoryid2"), {str(k): v for k, v in names.items()})
    paid = transactions.filter(F.col("at_mcccode").isNull() & F.col("category_description").isNotNull())
    return (
        paid.filter(F.col("at_categoryid2").isin(list(names)))
        .groupBy(name.alias("source"))
        .agg((-F.sum("dollars") / fixed.CUSTOMER_MONTHS).alias("amount"))
    )


def unlisted_payments(transactions: DataFrame) -> DataFrame:
    """One row, ``amount``: bills paid from the account that have none of the listed codes."""
    listed = [fixed.TELECOM_PAYMENT, fixed.UTILITY_PAYMENT, fixed.INSURANCE_PAYMENT]
    paid = transactions.filter(F.col("at_mcccode").isNull() & F.col("category_description").isNotNull())
    rest = paid.filter(~F.coalesce(F.col("at_categoryid2").isin(listed), F.lit(False)))
    return rest.agg((-F.sum("dollars") / fixed.CUSTOMER_MONTHS).alias("amount"))


def part_shares(matched: DataFrame, group: str) -> DataFrame:
    """(source, category, share): what part of a category is taxes, casinos, ..."""
    code = F.col("mcc")
    source = (
        F.when(code.isin(fixed.TAX_CODES), "tax")
        .when(code.isin(fixed.CASINO_CODES), "casino")
        .when(code == fixed.DISCOUNT_CODE, "discount")
        .when(code == fixed.WHOLESALE_CODE, "wholesale")
    )
    # one small table of (category, source, spend); both sums come from it
    cells = matched.groupBy(
        reshape.collapsed(F.col(group), fixed.MERCHANT_CATEGORIES).alias("category"), source.alias("source")
    ).agg(F.sum("spend_month").alias("spend"))
    totals = cells.groupBy("category").agg(F.sum("spend").alias("total"))
    parts = (
        cells.dropna(subset=["source"])
        .groupBy("source")
        .agg(F.sum("spend").alias("part"))
        .withColumn("category", reshape.recoded(F.col("source"), fixed.PARTS))
    )
    return parts.join(totals, "category").select("source", "category", ratio(F.col("part"), F.col("total")).alias("share"))


def sources_of(amounts: DataFrame, shares: DataFrame) -> DataFrame:
    """(source, amount): the categories themselves and their special parts."""
    parts = amounts.join(shares, "category").select("source", (F.col("amount") * F.col("share")).alias("amount"))
    return amounts.select(F.col("category").alias("source"), "amount").unionByName(parts)


def moved(amounts: DataFrame, sources: DataFrame, rules: dict[str, tuple[str, dict[str, float]]]) -> DataFrame:
    """One stage of reallocation by a rule dictionary of the fixed values."""
    rows = [(c, s, float(k), mode) for c, (mode, parts) in rules.items() for s, k in parts.items()]
    table = reshape.literal_table(amounts.sparkSession, ["category", "source", "coef", "mode"], rows)
    return crosswalk.reallocate(amounts, sources, table, "category", "amount")


def claimant_amounts(spend: DataFrame) -> DataFrame:
    """(category, amount) of claimants, as delivered."""
    return spend.select(F.col("category"), F.col("spend").alias("amount")).filter(
        F.col("category") != fixed.MERGED_CLAIMANT_CATEGORY
    )


def cash_total(claimants: DataFrame) -> DataFrame:
    return claimants.filter(F.col("category").isin(fixed.CASH_CATEGORIES)).agg(F.sum("amount").alias("amount"))


def bank_amounts(claimants: DataFrame, shares: DataFrame) -> DataFrame:
    """Claimants' spending moved to comparable categories, and the cash row."""
    kept = moved(claimants, sources_of(claimants, shares), fixed.BANK_RULES).dropna("any")
    cash = cash_total(claimants).select(F.lit(fixed.CASH_ROW).alias("category"), "amount")
    return kept.unionByName(cash)


def survey_amounts(lines: DataFrame, shares: DataFrame, transport: DataFrame) -> DataFrame:
    """Expenditure survey amounts moved alike; ``transport`` is a one-row amount of
    public transport, part of which is flights."""
    sources = sources_of(lines, shares).unionByName(transport.select(F.lit("transport").alias("source"), "amount"))
    kept = moved(lines, sources, {**fixed.BENCHMARK_RULES, **fixed.TRANSPORT_RULE})
    flights = transport.select(F.lit("Flights").alias("category"), (fixed.FLIGHT_PART * F.col("amount")).alias("amount"))
    return kept.unionByName(flights)


def accounts_amounts(lines: DataFrame, shares: DataFrame, uncovered: str) -> DataFrame:
    """National accounts moved alike, then cut to what households pay themselves;
    the rest goes to the category named ``uncovered``."""
    first = moved(lines, sources_of(lines, shares), fixed.BENCHMARK_RULES)
    rules = {**fixed.OUT_OF_POCKET_RULES, uncovered: ("add", fixed.NOT_OUT_OF_POCKET)}
    return moved(first, first.withColumnRenamed("category", "source"), rules)


def bank_table(options: DataFrame, bank: DataFrame, survey: DataFrame, accounts: DataFrame, uncovered: str) -> DataFrame:
    """Spending by the bank's categories in the three sources.

    ``options`` has (grp, category).  Of the group "Others" only ``uncovered`` shows.
    """
    table = crosswalk.coverage_table(
        options,
        {
            "bank_spend": bank.withColumnRenamed("amount", "bank_spend"),
            "survey_spend": survey.withColumnRenamed("amount", "survey_spend"),
            "accounts_spend": accounts.withColumnRenamed("amount", "accounts_spend"),
        },
        category="category",
        group="grp",
        group_levels=fixed.GROUP_LEVELS,
        ratios={"ratio_bank_survey": ("bank_spend", "survey_spend"), "ratio_bank_accounts": ("bank_spend", "accounts_spend")},
    )
    hidden = F.col("category").isin(fixed.HIDDEN_CATEGORIES) | ((F.col("grp") == "Others") & (F.col("category") != uncovered))
    return table.filter(~hidden)


def claimant_sources(claimants: DataFrame, shares: DataFrame, payments: DataFrame, cash_kinds: DataFrame) -> DataFrame:
    """Everything that survey and accounts categories draw on.

    ``cash_kinds`` (source, share) splits cash spending into "nondurable cash" and
    "durable cash", from the payment diary.
    """
    cash = cash_kinds.select("source", (F.col("share") * cash_total(claimants).scalar()).alias("amount"))
    return sources_of(claimants, shares).unionByName(payments).unionByName(cash)


def _all_categories(amounts: DataFrame, *others: DataFrame) -> DataFrame:
    """Amounts per category, 0 for categories that only another table has."""
    stacked = amounts.select("category", "amount")
    for other in others:
        stacked = stacked.unionByName(other.select("category", F.lit(0.0).alias("amount")))
    return (
        stacked.dropna(subset=["category"]).groupBy("category").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"))
    )


def survey_items(items: DataFrame, options: DataFrame) -> DataFrame:
    """(category, amount) per month of the survey items that are categories."""
    dwellings = [item for parts in fixed.SURVEY_DWELLINGS.values() for item in parts]
    listed = items.join(options.select(F.col("category").alias("item")), "item", "left_semi")
    kept = listed.filter(~F.col("item").isin(dwellings)).unionByName(items.filter(F.col("item").isin(dwellings)))
    return kept.groupBy(reshape.collapsed(F.col("item"), fixed.SURVEY_DWELLINGS).alias("category")).agg(
        (F.sum("amount") / 12).alias("amount")
    )


def survey_table(options: DataFrame, bank: DataFrame, survey: DataFrame, sources: DataFrame) -> DataFrame:
    """Spending by the expenditure survey's categories, with shares."""
    own = moved(_all_categories(bank, survey, options), sources, fixed.SURVEY_RULES)
    own = moved(own, sources, fixed.SURVEY_PAYMENT_RULES)
    return crosswalk.coverage_table(
        options,
        {
            "bank_spend": own.withColumnRenamed("amount", "bank_spend"),
            "survey_spend": _all_categories(survey, bank, options).withColumnRenamed("amount", "survey_spend"),
        },
        category="category",
        group="grp",
        group_levels=fixed.GROUP_LEVELS,
        shares={"share_bank": "bank_spend", "share_survey": "survey_spend"},
        ratios={"ratio_bank_survey": ("bank_spend", "survey_spend")},
        merge=fixed.SURVEY_MERGE,
        complete_only=True,
    )


def accounts_table(options: DataFrame, bank: DataFrame, accounts: DataFrame, sources: DataFrame) -> DataFrame:
    """Spending by the national accounts' categories."""
    own = moved(_all_categories(bank, accounts, options), sources, fixed.ACCOUNTS_RULES)
    own = moved(own, sources, fixed.ACCOUNTS_PAYMENT_RULES)
    merged = (
        _all_categories(accounts, bank, options)
        .groupBy(reshape.collapsed(F.col("category"), fixed.ACCOUNTS_MERGE).alias("category"))
        .agg(F.sum("amount").alias("amount"))
    )
    paid = moved(merged, merged.withColumnRenamed("category", "source"), fixed.ACCOUNTS_OUT_OF_POCKET_RULES)
    return crosswalk.coverage_table(
        options,
        {
            "bank_spend": own.withColumnRenamed("amount", "bank_spend"),
            "accounts_spend": paid.withColumnRenamed("amount", "accounts_spend"),
        },
        category="category",
        group="grp",
        group_levels=fixed.GROUP_LEVELS,
        ratios={"ratio_bank_accounts": ("bank_spend", "accounts_spend")},
        merge=fixed.ACCOUNTS_MERGE,
        complete_only=True,
    )
