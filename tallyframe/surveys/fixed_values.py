"""Fixed values.

Everything here must equal the published study for its tables to come out right:
level groups, code lists, reallocation coefficients and constants, in the order of
the study.  Nothing here is logic.
"""

# --- households -----------------------------------------------------------------

LOWEST_BASE_WAGE = 15000
OWN_BANK_CARD_SHARE = 0.37
BALANCE_BIN, BALANCE_TOP = 500, 13500
HOUSEHOLD_FACTS = {
    "payroll_deposit": "85%",
    "claimants_with_account": "90%",
    "claimants_with_card": "72%",
    "claimants_with_one_card": "15%",
    "claimants_with_more_cards": "57%",
    "claimants_with_outside_card": "64%",
}
SHORT_DURATION_COLUMNS = ["Less Than 10", "10 to 14", "15 to 19", "20 to 21"]
SHORT_DURATION_FACT = "15%"

# --- benefit recipients in the person-month panel ---------------------------------

LONG_CODE_WAVE = 7
CALENDAR_BASE_YEAR = 2003
PRICE_BASE_YEAR = 2004
COLLEGE_CODE, BACHELOR_CODE = 40, 44
UNEMPLOYED_CODES = [5, 6, 7]
PAID_BY_DEPOSIT = 0.86
EARLIEST_PLACEBO = 16
PLACEBO_SEED = 123
INCOME_BIN, INCOME_TOP = 10000, 200000
YOUNG_AGE = 20
MEAN_HEAD_AGE_FACT = "44"

# --- spending by merchant code ----------------------------------------------------

CUSTOMER_MONTHS = 118018
CONSUMER_UNITS_MILLION = 125
CASH_CODE = 6011
TAX_CODES = [9211, 9222, 9223, 9311, 9405]
CASINO_CODES = [3662, 3730, 3731, 3774]
DISCOUNT_CODE = 5310
WHOLESALE_CODE = 5300
TELECOM_PAYMENT, UTILITY_PAYMENT, INSURANCE_PAYMENT = 16001, 16003, 17008
SURVEY_HEADINGS = ["Mean", "Share", "SE"]
GROUP_LEVELS = ["ND", "D", "Others"]

MERCHANT_CATEGORIES = {
    "Auto Repair": ["autopartsmfr", "autodealer_svcs", "autodealer_repair", "autodealer_dur"],
    "Department Stores": "departmentstore",
    "Drug Stores": "drugstore",
    "Entertainment": ["entertainment", "otherretail_pool"],
    "Flights": "travel_air",
    "Food Away From Home": ["restaurant_main", "restaurant_alc"],
    "Groceries": ["grocery_main", "grocery_alc"],
    "Ground Transportation": ["transitcommute", "fuel"],
    "Home Improvement": ["homeimprovement_dur", "homeimprovement_flowr"],
    "Hotels & Rental Cars": ["travel_auto", "travel_lodging", "travel_svcs"],
    "Insurance": "insurance",
    "Medical Copay": [
        "healthcare_equp_gen", "healthcare_equp_oth", "healthcare_phys_gen", "healthcare_dntl", "healthcare_phys_oth",
        "healthcare_optl_gen", "healthcare_optl_rtl", "healthcare_hosp", "healthcare_svcs_oth",
    ],
    "Miscellaneous Durables": ["school", "notforprofitorg", "membershiporg", "politcalorg"],
    "Miscellaneous Nondurables": [
        "others_main", "others_unpred", "others_tax", "electronicsappls_nondur", "onlinemarket", "directmktgcatalog",
    ],
    "Professional & Personal Services": ["profperslsvcs_main", "profperslsvcs_home", "profperslsvcs_unpred"],
    "Retail Durables": ["otherretail_dur", "electronicsappls_dur"],
    "Retail Nondurables": ["discountstore", "otherretail_nondur"],
    "Telecom": "utilities_telecomm",
    "Utilities": "utilities_main",
    "Not in benchmark": ["autodealer_mobile", "healthcare_ambl"],
}
CASH_CATEGORIES = ["Cash", "Online", "Miscellaneous Nondurables"]
CASH_ROW = "Cash and Miscellaneous Nondurables"
MERGED_CLAIMANT_CATEGORY = "Discount Stores"
HIDDEN_CATEGORIES = ["Department Stores", "Miscellaneous Nondurables"]

# Part of a category that is really something else: {source: category it is part of}.
PARTS = {
    "tax": "Miscellaneous Nondurables",
    "casino": "Hotels & Rental Cars",
    "discount": "Retail Nondurables",
    "wholesale": "Retail Nondurables",
}

# {category: (mode, {source: coefficient})}
BANK_RULES = {
    "Department Stores": ("set", {"nothing": 1}),
    "Drug Stores": ("set", {"Drug Stores": 0.3, "discount": 0.1}),
    "Entertainment": ("add", {"casino": 0.55, "discount": 0.1}),
    "Food Away From Home": ("add", {"casino": 0.2}),
    "Groceries": ("set", {"Groceries": 0.75, "discount": 0.5, "wholesale": 0.6}),
    "Home Improvement": ("add", {"Department Stores": 0.1, "discount": 0.15, "wholesale": 0.1}),
    "Hotels & Rental Cars": ("add", {"casino": -0.75}),
    "Medical Copay": ("add", {"wholesale": 0.05}),
    "Miscellaneous Nondurables": ("add", {"tax": -1}),
    "Professional & Personal Services": ("add", {"Department Stores": 0.1, "Drug Stores": 0.4, "wholesale": 0.1}),
    "Retail Nondurables": (
        "add", {"Department Stores": 0.8, "discount": -0.85, "Drug Stores": 0.3, "Groceries": 0.25, "wholesale": -0.85},
    ),
}
# The benchmark sources have no department stores; both count discount stores with the
# opposite sign in retail nondurables.
BENCHMARK_RULES = {
    "Drug Stores": ("set", {"Drug Stores": 0.3, "discount": 0.1}),
    "Entertainment": ("add", {"casino": 0.55, "discount": 0.1}),
    "Food Away From Home": ("add", {"casino": 0.2}),
    "Groceries": ("set", {"Groceries": 0.75, "discount": 0.5, "wholesale": 0.6}),
    "Home Improvement": ("add", {"discount": 0.15, "wholesale": 0.1}),
    "Hotels & Rental Cars": ("add", {"casino": -0.75}),
    "Medical Copay": ("add", {"wholesale": 0.05}),
    "Miscellaneous Nondurables": ("add", {"tax": -1}),
    "Professional & Personal Services": ("add", {"Drug Stores": 0.4, "wholesale": 0.1}),
    "Retail Nondurables": ("add", {"discount": 0.85, "Drug Stores": 0.3, "Groceries": 0.25, "wholesale": -0.85}),
}
PUBLIC_TRANSPORT_ITEM = "Public and other transportation"
FLIGHT_PART = 0.64
TRANSPORT_RULE = {"Ground Transportation": ("add", {"transport": -0.64})}
# Second stage for the national accounts: only part of drugs and medical care is paid
# by households.
OUT_OF_POCKET_RULES = {
    "Drug Stores": ("set", {"Drug Stores": 0.14}),
    "Medical Copay": ("set", {"Medical Copay": 0.124}),
}
NOT_OUT_OF_POCKET = {"Drug Stores": 0.86, "Medical Copay": 0.876}

SURVEY_RULES = {
    "Apparel and services": ("add", {"Department Stores": -0.2, "discount": 0.15}),
    "Cash": ("set", {"nothing": 1}),
    "Drugs": ("set", {"Drug Stores": 0.3, "discount": 0.1}),
    "Food at home": ("add", {"discount": -0.5, "Groceries": -0.25, "wholesale": -0.4}),
    "Food away from home": ("add", {"casino": 0.2}),
    "Household operations": ("add", {"Department Stores": 0.1, "discount": 0.15, "wholesale": 0.1}),
    "Housekeeping supplies": ("add", {"Groceries": 0.25}),
    "Medical supplies": ("add", {"wholesale": 0.05}),
    "Miscellaneous": ("add", {"Drug Stores": 0.3}),
    "Other entertainment supplies, equipment, and services": ("add", {"casino": -0.45, "discount": 0.1, "wholesale": 0.15}),
    "Other lodging": ("add", {"casino": 0.25}),
    "Personal care products and services": ("add", {"Department Stores": 0.1, "Drug Stores": 0.4, "wholesale": 0.1}),
    "Nondurable Cash and Online Pay": ("set", {"nondurable cash": 1}),
    "Durable Cash and Online Pay": ("set", {"durable cash": 1}),
}
SURVEY_PAYMENT_RULES = {
    "Utilities, fuels, and public services": ("set", {"telecom": 1, "utilities": 1}),
    "Health insurance": ("set", {"insurance": 1}),
}
SURVEY_DWELLINGS = {"Owned and rented dwellings": ["Owned dwellings", "Rented dwellings"]}
SURVEY_MERGE = {
    "Medical": ["Medical services", "Medical supplies"],
    "Not comparable": [
        "Audio and visual equipment and services", "Pensions and Social Security", "Health insurance",
        "Life and other personal insurance", "Vehicle purchases (net outlay)", "Owned and rented dwellings", "Cash contributions",
    ],
}

ACCOUNTS_RULES = {
    "Cash": ("set", {"nothing": 1}),
    "Clothing and footwear": ("add", {"Department Stores": -0.2, "discount": 0.15}),
    "Pharmaceutical products": ("set", {"Drug Stores": 0.3, "discount": 0.1, "wholesale": 0.05}),
    "Food and nonalcoholic beverages purchased for off-premises consumption": (
        "add", {"discount": -0.5, "Groceries": -0.25, "wholesale": -0.4},
    ),
    "Food services": ("add", {"casino": 0.2}),
    "Gambling": ("add", {"casino": -0.6}),
    "Hotels and motels": ("add", {"casino": 0.25}),
    "Housing supplies": ("add", {"Department Stores": 0.1, "discount": 0.15, "Groceries": 0.25, "wholesale": 0.1}),
    "Personal care products and services": ("add", {"Department Stores": 0.1, "Drug Stores": 0.4, "wholesale": 0.15}),
    "Recreation - Other": ("add", {"Drug Stores": 0.3, "casino": 0.15}),
    "Video, audio, photographic, and information processing equipment, media, and services": (
        "add", {"discount": 0.1, "wholesale": 0.15},
    ),
    "Nondurable Cash and Online Pay": ("set", {"nondurable cash": 1}),
    "Durable Cash and Online Pay": ("set", {"durable cash": 1}),
}
ACCOUNTS_PAYMENT_RULES = {
    "Telecommunication services": ("set", {"telecom": 1}),
    "Household utilities": ("set", {"utilities": 1}),
    "Health insurance": ("set", {"insurance": 1}),
}
ACCOUNTS_MERGE = {
    "Recreation - Other": "Gambling",
    "Telecom": ["Telecommunication services", "Internet access"],
    "Medical": ["Outpatient services", "Hospital and nursing home services", "Other medical products"],
    "Not comparable": [
        "Health insurance", "Motor vehicles", "Life insurance", "Net foreign spending", "Housing", "Package tours",
        "Financial services",
    ],
}
ACCOUNTS_OUT_OF_POCKET_RULES = {
    "Pharmaceutical products": ("set", {"Pharmaceutical products": 0.14}),
    "Medical": ("set", {"Medical": 0.124}),
    "Not comparable": ("add", {"Pharmaceutical products": 0.86, "Medical": 0.876}),
}

# --- payment diary ------------------------------------------------------------------

DIARY_MONTH = 10
DIARY_OUTLIER = 70000
PEOPLE_PER_HOUSEHOLD = 235036000 / 114960000
DIARY_CATEGORIES = {
    "food": ["1", "2", "3", "10", "11", "12", "13", "14", "32"],
    "housing": ["18", "20", "21", "22", "23", "24", "25", "26", "27", "28", "38", "39"],
    "transport": ["4", "5", "6", "7", "8", "9", "19"],
    "recreation": ["15", "16", "17", "33"],
    "health": ["29", "31"],
    "finance": "35",
    "education": "30",
    "charity": ["40", "42", "43", "44"],
    "other": ["34", "36", "37", "41", "45"],
}
DURABILITY = {
    "strict": [
        "1", "2", "3", "7", "8", "9", "11", "14", "17", "18", "19", "21", "22", "24", "27", "28", "32", "33", "34", "36",
        "37", "38",
    ],
    "nondurable": ["10", "12", "13", "29", "31"],
    "durable": ["4", "5", "6", "15", "16", "20", "23", "25", "30", "35", "39", "40"],
    "taxes": "41",
    "inter-household transfer": ["42", "44"],
    "misc consumption": "43",
    "missing": ["26", "45"],
}
PAYMENTS = {
    "Cash": "1",
    "Check": "2",
    "Credit Card": "3",
    "Debit Card": ["4", "5"],
    "Electronic Transfer": "7",
    "Online Pay": "8",
    "Other": ["6", "9", "11", "12", "13"],
}
CONSUMPTION_KINDS = ["strict", "nondurable", "durable", "taxes", "inter-household transfer"]
