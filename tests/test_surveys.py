"""The studies on published inputs where these exist, else on small hand-made ones."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.crosswalk import currency_group_mean
from tallyframe.surveys import diary, households, recipients, spending
from tallyframe.surveys import fixed_values as fixed

# Published inputs and results.
CLAIMANT_SPEND = {
    "Department Stores": 20.7, "Retail Nondurables": 156.8, "Hotels & Rental Cars": 28.3, "Flights": 32.4,
    "Food Away From Home": 215.5, "Ground Transportation": 169.5, "Cash": 664.5, "Online": 44, "Drug Stores": 37,
    "Entertainment": 33.5, "Discount Stores": 59.5, "Retail Durables": 54.8, "Home Improvement": 47.7,
    "Professional & Personal Services": 58, "Auto Repair": 45.1, "Groceries": 320.8, "Telecom": 113.3, "Utilities": 177.5,
    "Miscellaneous Nondurables": 280.5, "Insurance": 148.4, "Miscellaneous Durables": 29.2, "Medical Copay": 35,
}
CODE_SPEND = [
    (3662, 0.0186564761, "travel_lodging"), (3730, 0.0447362267, "travel_lodging"), (3731, 0.035960023, "travel_lodging"),
    (1, 12.780089, "travel_lodging"), (2, 2.091742, "travel_auto"), (3, 4.38386, "travel_svcs"),
    (5300, 29.3099915267, "discountstore"), (5310, 19.2234176143, "discountstore"), (4, 6.660824, "discountstore"),
    (5, 108.01686, "otherretail_nondur"),
    (9211, 0.6937995899, "others_main"), (9223, 0.1446281076, "others_main"), (6, 43.177844, "others_main"),
    (9222, 1.0441674999, "others_unpred"), (9311, 2.4279675134, "others_tax"),
    (7, 0.288927, "electronicsappls_nondur"), (8, 17.334634, "onlinemarket"), (9, 14.637414, "directmktgcatalog"),
]
PUBLISHED_BANK_SPEND = {
    "Cash and Miscellaneous Nondurables": 989, "Drug Stores": 13, "Flights": 32, "Food Away From Home": 216, "Groceries": 267,
    "Ground Transportation": 170, "Medical Copay": 36, "Professional & Personal Services": 78, "Retail Nondurables": 225,
    "Telecom": 113, "Utilities": 178, "Auto Repair": 45, "Entertainment": 35, "Home Improvement": 55,
    "Hotels & Rental Cars": 28, "Insurance": 148, "Miscellaneous Durables": 29, "Retail Durables": 55,
}
DURATIONS = """Arizona,130905,0,5042,16508,6455
Colorado,119666,2584,8242,15930,6974
Idaho,38254,0,6571,4428,3608
Illinois,348270,0,0,0,1
Kentucky,119227,0,0,158,102
Louisiana,104881,0,0,0,0
Nevada,96810,58,4904,13100,5309
New Jersey,331315,1787,6199,12079,14089
New York,490955,0,0,0,0
Ohio,229848,3,6,30,7004
Oklahoma,87145,1,0,2605,3089
Oregon,142069,2110,3964,6509,2756
Texas,676381,0,75066,101410,50613
Utah,57079,0,7185,10502,5305
Washington,217627,80,317,19344,11999
West Virginia,62268,0,0,0,0
Wisconsin,225922,809,4044,24917,9771"""
WEEKLY = {
    "Arizona": "224.55 224.81 223.79 222.11 221.85 221.49 220.31 220.53 221.82 223.12 224.15 225.26",
    "Colorado": "371.97 373.72 380.37 385.77 389.27 388.26 389.51 396.30 404.30 405.19 401.51 401.27",
}
WEEKLY_MEAN = {"Arizona": 222.815833333333, "Colorado": 390.62}


def test_claimant_spending_after_reallocation_equals_the_published_column(spark):
    claimants = spark.createDataFrame([(k, float(v)) for k, v in CLAIMANT_SPEND.items()], "category string, spend double")
    matched = spark.createDataFrame(CODE_SPEND, "mcc int, spend_month double, grp string")
    shares = spending.part_shares(matched, "grp")
    bank = spending.bank_amounts(spending.claimant_amounts(claimants), shares)
    got = {r.category: r.shown for r in bank.select("category", F.bround("amount", 0).alias("shown")).collect()}
    assert {k: got[k] for k in PUBLISHED_BANK_SPEND} == PUBLISHED_BANK_SPEND
    assert "Department Stores" not in got


def test_short_durations(spark):
    rows = [(s, *map(int, v)) for s, *v in (line.split(",") for line in DURATIONS.splitlines())]
    df = spark.createDataFrame(rows, ["state", "Total Potential", *fixed.SHORT_DURATION_COLUMNS])
    share = households.short_duration_share(df).first().share
    assert share == pytest.approx(0.14634, abs=5e-6) and f"{share:.0%}" == fixed.SHORT_DURATION_FACT


def test_weekly_benefits(spark):
    rows = [(s, f"${x} ") for s, text in WEEKLY.items() for x in text.split()]
    out = currency_group_mean(spark.createDataFrame(rows, "State string, Weekly string"), "State", "Weekly", "mean")
    assert {r.State: r["mean"] for r in out.collect()} == pytest.approx(WEEKLY_MEAN)


def test_duplicate_codes_keep_their_largest_amount(spark):
    # published transactions of three codes that appear more than once
    rows = [
        (5541, 20006, "fuel    ", "Fuel", -451.04), (5541, 20009, "fuel    ", "Restaurant", -199.59),
        (5541, 20021, "fuel    ", "Repairs", -3641226.73), (7399, 20022, "onlinemarket ", "Misc", -663550.21),
        (7399, 21012, "onlinemarket ", "Equipment", -24.7), (6011, 20013, "cash ", "Cash", -1e9),
        (None, 16001, None, "Telecom", -1480664.04), (None, 16003, None, "General", -14856922.34),
        (None, 17008, None, "Insurance", -11426537.32), (None, 17010, None, "Rent", -1638356.06), (None, None, None, None, -2e8),
    ]
    df = spark.createDataFrame(rows, "at_mcccode int, at_categoryid2 int, grp string, category_description string, dollars double")
    codes = spark.createDataFrame(
        [(1, 5541, "Service Stations"), (2, 5541, "Other"), (3, 7399, "Business Services")], "line int, mcc_code int, edited_description string"
    )
    out = spending.matched_codes(df, spending.code_labels(codes, "line"), "grp").orderBy("mcc").collect()
    assert [(r.mcc, r.dollars, r.grp, r.mcc_merchant_type) for r in out] == [
        (5541, 3641226.73, "fuel", "Service Stations"),
        (7399, 663550.21, "onlinemarket", "Business Services"),
    ]
    assert out[0].spend_month == pytest.approx(3641226.73 / 118018)
    again = codes.union(spark.createDataFrame([(4, 5541, "Service Stations")], codes.schema))
    assert spending.code_labels(again, "line").count() == 2
    rest = spending.unlisted_payments(df).first().amount
    assert rest == pytest.approx((sum(r[4] for r in rows if r[0] is None and r[3]) * -1 - sum(v * 118018 for v in (12.546, 125.887, 96.820))) / 118018, abs=1e-2)
    paid = {r.source: r.amount for r in spending.other_payments(df).collect()}
    assert paid == pytest.approx({"telecom": 12.546, "utilities": 125.887, "insurance": 96.820}, abs=1e-3)


def amounts(spark, table):
    return spark.createDataFrame([(k, float(v)) for k, v in table.items()], "category string, amount double")


def test_three_way_table(spark):
    options = spark.createDataFrame(
        [("ND", "Drug Stores"), ("ND", "Medical Copay"), ("D", "Entertainment"), ("Others", "Cash"), ("Others", "Uncovered"),
         ("ND", "Department Stores"), ("ND", "Flights"), ("ND", "Ground Transportation")],
        "grp string, category string",
    )
    shares = spark.createDataFrame([("casino", "Entertainment", 0.1)], "source string, category string, share double")
    lines = amounts(spark, {"Drug Stores": 100, "Medical Copay": 50, "Entertainment": 10, "Uncovered": 7, "Ground Transportation": 80})
    transport = spark.sql("SELECT 20.0D AS amount")
    survey = {r.category: r.amount for r in spending.survey_amounts(lines, shares, transport).collect()}
    assert survey == pytest.approx(
        {"Drug Stores": 30, "Medical Copay": 50, "Entertainment": 10.55, "Uncovered": 7, "Ground Transportation": 67.2, "Flights": 12.8}
    )
    accounts = spending.accounts_amounts(lines, shares, "Uncovered")
    got = {r.category: r.amount for r in accounts.collect()}
    assert got["Drug Stores"] == pytest.approx(4.2) and got["Medical Copay"] == pytest.approx(6.2)
    assert got["Uncovered"] == pytest.approx(7 + 25.8 + 43.8)
    bank = amounts(spark, {"Drug Stores": 11.1, "Entertainment": 5, "Department Stores": 3, "Cash": 9})
    table = spending.bank_table(options, bank, spending.survey_amounts(lines, shares, transport), accounts, "Uncovered")
    assert [(r.category, r.bank_spend, r.survey_spend, r.ratio_bank_survey, r.accounts_spend) for r in table.collect()] == [
        ("Drug Stores", 11.0, 30.0, 0.37, 4.0),
        ("Flights", None, 13.0, None, None),
        ("Ground Transportation", None, 67.0, None, 80.0),
        ("Medical Copay", None, 50.0, None, 6.0),
        ("Entertainment", 5.0, 11.0, 0.47, 11.0),
        ("Uncovered", None, 7.0, None, 77.0),
    ]


def test_survey_and_accounts_tables(spark):
    claimants = amounts(spark, {"Drug Stores": 40, "Groceries": 80, "Department Stores": 10, "Cash": 100, "Retail Nondurables": 50})
    shares = spark.createDataFrame([("discount", "Retail Nondurables", 0.2)], "source string, category string, share double")
    payments = spark.createDataFrame([("telecom", 12.0), ("utilities", 30.0), ("insurance", 9.0)], "source string, amount double")
    kinds = spark.createDataFrame([("nondurable cash", 0.75), ("durable cash", 0.25)], "source string, share double")
    sources = spending.claimant_sources(claimants, shares, payments, kinds)
    options = spark.createDataFrame(
        [("ND", "Drugs"), ("ND", "Food at home"), ("ND", "Nondurable Cash and Online Pay"), ("Others", "Not comparable"),
         ("ND", "Medical"), ("D", "Utilities, fuels, and public services"), ("D", "Reading"), ("D", "Health insurance")],
        "grp string, category string",
    )
    items = spark.createDataFrame(
        [("Drugs", 240.0), ("Food at home", 1200.0), ("Owned dwellings", 600.0), ("Rented dwellings", 60.0), ("Something", 5.0)],
        "item string, amount double",
    )
    bank = amounts(spark, {"Drugs": 1, "Food at home": 90, "Medical supplies": 3, "Medical services": 4})
    out = spending.survey_table(options, bank, spending.survey_items(items, options), sources)
    # discount is 10: drugs 0.3 * 40 + 0.1 * 10, food 90 - 0.5 * 10 - 0.25 * 80; total 13+65+7+75+42+9
    assert [(r.category, r.bank_spend, r.survey_spend, r.ratio_bank_survey, r.share_bank) for r in out.collect()] == [
        ("Drugs", 13.0, 20.0, 0.65, 0.06),
        ("Food at home", 65.0, 100.0, 0.65, 0.31),
        ("Medical", 7.0, 0.0, None, 0.03),
        ("Nondurable Cash and Online Pay", 75.0, 0.0, None, 0.36),
        ("Utilities, fuels, and public services", 42.0, 0.0, None, 0.2),
        ("Not comparable", 9.0, 55.0, 0.16, 0.04),
    ]
    lines = amounts(spark, {"Pharmaceutical products": 100, "Outpatient services": 50, "Housing": 10, "Internet access": 20})
    names = spark.createDataFrame(
        [("ND", "Pharmaceutical products"), ("ND", "Medical"), ("ND", "Telecom"), ("Others", "Not comparable"),
         ("ND", "Telecommunication services"), ("ND", "Health insurance")],
        "grp string, category string",
    )
    by_accounts = spending.accounts_table(names, amounts(spark, {"Pharmaceutical products": 5}), lines, sources).collect()
    assert [(r.category, r.bank_spend, r.accounts_spend) for r in by_accounts] == [
        ("Medical", 0.0, 6.0), ("Pharmaceutical products", 13.0, 14.0), ("Telecom", 12.0, 20.0), ("Not comparable", 9.0, 140.0),
    ]


def test_diary_tables(spark):
    rows = [
        (1, 2.0, 1, "10/1/2012", 30.0, 1, 1), (1, 2.0, 3, "10/3/2012", 60.0, 1, 4), (2, 1.0, 5, "10/5/2012", 10.0, 3, 10),
        (2, 1.0, 5, "10/5/2012", 70000.0, 3, 4), (3, 1.0, 5, "9/5/2012", 999.0, 3, 4), (2, 1.0, 5, "10/5/2012", 4.0, None, 4),
    ]
    df = spark.createDataFrame(rows, "prim_key long, ind_weight double, diary_day int, date string, amnt double, pi int, merch int")
    out = {r.payment: tuple(r)[1:5] for r in diary.durability_by_payment(df).collect()}
    # cash: 60 strict and 120 durable over three days; credit: 10 nondurable in one day
    assert out["Cash"] == ("33%", "67%", "100%", "0%")
    assert out["Credit Card"] == ("100%", "0%", "100%", "0%")
    cash, card = 180 * 31 / 3, 10 * 31
    durable = 120 * 31 / 3 / (cash + card)
    assert out["Total"] == (f"{1 - durable:.0%}", f"{durable:.0%}", "100%", "0%")
    assert [(r.category, r.ratio) for r in diary.category_shares(df).collect()] == [("food", round(70 / 194, 3)), ("transport", round(124 / 194, 3))]


def test_household_facts(spark):
    detail = spark.createDataFrame(
        [(1, 100.0, 1, 1, 0, 1, 1, 0, 0, 0, 1), (2, None, 1, 0, 1, 1, 2, 0, 0, 0, None), (3, 900.0, 5, 1, 1, 5, 0, 0, 0, 0, 2), (4, 13600.0, 1, 0, 0, 5, 0, 0, 0, 0, None)],
        "Y1 int, X3506 double, X5715 int, X4106 int, X4706 int, X410 int, X411 int, X419 int, X425 int, X428 int, X7123 int",
    )
    summary = spark.createDataFrame(
        [(1, 1.0, 20000.0, 0, 10.0), (2, 2.0, 30000.0, 0, 50.0), (3, 1.0, 16000.0, 0, 7.0), (4, 1.0, 90000.0, 1, 0.0)],
        "Y1 int, wgt double, wageinc double, nochk int, liq double",
    )
    df = households.households(detail, summary)
    facts = {r.fact: r.value for r in households.household_facts(df).collect()}
    assert facts == pytest.approx(
        {"payroll_deposit": 0.25, "claimants_with_account": 0.75, "claimants_with_card": 1.0, "claimants_with_one_card": 1 / 3,
         "claimants_with_more_cards": 2 / 3, "claimants_with_outside_card": 1 / 3 * 0.63 + 2 / 3}
    )
    assert [r["pass"] for r in households.published_facts(households.household_facts(df)).collect()].count(True) == 0
    assert [(r.bin, r.weight, r.share) for r in households.checking_distribution(df).collect()] == [(0.0, 3.0, 0.75), (500.0, 1.0, 0.25)]
    assert [tuple(r) for r in households.liquid_assets(df).orderBy("measure").collect()] == [
        ("checking_balance", 0.0, 0.0, 900.0, 250.0), ("liquid_assets", 7.0, 10.0, 50.0, 29.0),
    ]


@pytest.fixture(scope="module")
def waves(spark):
    """Three persons over 24 months: one gets benefits in month 20, one leaves work
    for unemployment in month 18, one works all the time."""
    rows = []
    for t in range(1, 25):
        wave, ref = (t - 1) // 4 + 1, (t - 1) % 4 + 1
        longer = "1" if wave == 7 else ""
        for p, name in enumerate(("101", "102", "103")):
            rows.append(
                (
                    f"u{p % 2}", "11", "1", longer + "11", longer + name, 101 if p % 2 == 0 else 102, ref, 2004 + (t - 1) // 12,
                    (t - 1) % 12 + 1, wave, 40 + p, 40 + 4 * p, 50.0 if name == "101" and t >= 20 else 0.0,
                    1000.0 * (p + 1), 5000.0, 6000.0 + t, 1000.0, 1, 1, 1, 2 if name == "102" and t == 17 else 1,
                    6 if name == "102" and t == 18 else 1, 5500.0 if t < 12 else 7000.0, 1.0 + p, 2.0,
                )
            )
    return spark.createDataFrame(
        rows,
        "ssuid string, shhadid string, rfid string, eentaid string, epppnum string, efrefper int, srefmon int, rhcalyr int, rhcalmn int, "
        "swave int, tage int, eeducate int, t05amt double, tpearn double, tfearn double, tftotinc double, tptotinc double, epopstat int, "
        "epdjbthn int, ejobcntr int, estlemp1 int, rmesr int, rfpov double, wpfinwgt double, wffinwgt double",
    )


@pytest.fixture(scope="module")
def people(spark, waves):
    days = spark.sql("SELECT explode(sequence(DATE'2004-01-01', DATE'2005-12-01', INTERVAL 1 MONTH)) AS day")
    prices = recipients.price_months(days.withColumn("price", F.lit(100.0) + F.month("day") * 0), "day", "price")
    return recipients.recipient_panel(waves, prices).cache()


def test_recipient_panel(people):
    got = {r.id: r for r in people.filter("period_index = 20").collect()}
    assert set(got) == {"u011101", "u111102", "u011103"}
    a, b, c = got["u011101"], got["u111102"], got["u011103"]
    assert (a.first_ui_date, a.last_ui_date, a.any_ui, a.mos_in_horizon) == (20, 24, True, 12)
    assert a.inc_prior_ui == pytest.approx(1000.0) and a.incf_prior_ui == pytest.approx(6000 + sum(range(8, 20)) / 12)
    assert (b.first_u_date, b.any_unemp, b.first_ui_date, b.any_ui) == (18, True, None, False)
    assert (a.n_members, b.n_members, a.n_adults, a.hfam_age, b.hfam_age, a.hfam_age_bin) == (2, 1, 2, 40, 41, 40.0)
    assert (c.any_coll, c.any_ba) == (True, True) and (a.any_coll, a.any_ba) == (True, False)


def test_calendar_prices_start_with_their_own_january(spark, waves):
    days = spark.sql("SELECT explode(sequence(DATE'2004-01-01', DATE'2005-12-01', INTERVAL 1 MONTH)) AS day")
    priced = days.withColumn("price", (F.year("day") - 2000) * 100.0 + F.month("day"))
    prices = recipients.price_months(priced, "day", "price")
    rows = recipients.recipient_panel(waves, prices, price_on="period_index_cal").select("period_index_cal", "price_index").distinct().collect()
    # month 13 of a calendar that starts in 2003 is January 2004
    index = {r.period_index_cal: r.price_index for r in rows}
    assert index[13] == pytest.approx(512 / 401) and index[24] == pytest.approx(512 / 412)
    assert all(v is None for m, v in index.items() if m < 13)


def test_an_unknown_month_leaves_yearly_income_unknown(spark, people):
    gap = people.withColumn("tfearn_adj", F.when(~((F.col("id") == "u011101") & (F.col("period_index") == 9)), F.col("tfearn_adj")))
    whole = {r.bin: r.wt_earn for r in recipients.income_distributions(people).collect()}
    out = {r.bin: r.wt_earn for r in recipients.income_distributions(gap).collect()}
    assert whole[60000.0] - out[60000.0] == 1.0 and out[None] == 1.0


def test_cohort_table(people):
    stack = recipients.cohorts(people)
    assert {r.key for r in stack.select("key").distinct().collect()} >= {"Unemployed: All", "Unemployed: Get UI"}
    rows = {r.key: r for r in recipients.representativeness(stack, scaled_row=True).collect()}
    ui = rows["Unemployed: Get UI"]
    assert ui["Fam Inc"] == ui["Median Fam Inc"] == pytest.approx(6000 + sum(range(5, 17)) / 12)
    assert ui["Person Earn"] == pytest.approx(1000) and ui["Others' Earn"] == pytest.approx(4000)
    # poor in months 12 to 16 of the window 5 to 16
    assert ui["Poverty Rate"] == pytest.approx(5 / 12)
    scaled = rows["Unemployed: Get UI, Pay DD"]
    assert scaled["Person Earn"] == pytest.approx(860) and scaled["Median Fam Inc"] is None
    assert rows["Unemployed: All"]["Person Earn"] == pytest.approx(2000)


def test_age_and_income(people):
    assert recipients.mean_head_age(people).first().mean_age == pytest.approx(40.0)
    assert [tuple(r) for r in recipients.age_distribution(people).collect()] == [(40.0, 1.0, 1.0)]
    out = {r.bin: r for r in recipients.income_distributions(people).collect()}
    assert out[60000.0].wt_earn == 6.0 and out[60000.0].pct_earn == 1.0 and out[60000.0].wt_earn_ui == 1.0
    assert out[70000.0].pct_inc == 1.0 and out[70000.0].pct_inc_ui == 1.0
