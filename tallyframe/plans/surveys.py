"""Survey facts, summaries and distributions; crosswalks and diaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.numbers import floor_bin, ratio
from tallyframe.functions.text import yes_no
from tallyframe.operators import crosswalk, reshape, weights
from tallyframe.operators import panel as panels
from tallyframe.plans.inputs import (
    CATEGORY_SPEND,
    DIARY,
    HOUSEHOLDS,
    MONTHS,
    benchmark_spend,
    category_spend,
    diary,
    households,
    months,
    part_spend,
)
from tallyframe.plans.registry import Tables, query, rounded
from tallyframe.session import materialise


@query(f"""
WITH {HOUSEHOLDS}, f AS (
  SELECT sum(wgt * any_card::INT) FILTER (NOT nochk) / sum(wgt) FILTER (NOT nochk) AS deposit,
         1 - sum(wgt * nochk::INT) FILTER (claims) / sum(wgt) FILTER (claims) AS banked,
         sum(wgt * any_card::INT) FILTER (claims AND NOT nochk) / sum(wgt) FILTER (claims AND NOT nochk) AS any_card,
         sum(wgt * one_card::INT) FILTER (claims AND NOT nochk) / sum(wgt) FILTER (claims AND NOT nochk) AS one_card
  FROM households), g AS (SELECT *, one_card * (1 - 0.37 / any_card) + any_card AS outside FROM f)
SELECT unnest(['deposit', 'banked', 'any_card', 'one_card', 'outside']) AS fact,
       round(unnest([deposit, banked, any_card, one_card, outside]), 6) AS value FROM g""")
def survey_facts(t: Tables):
    banked = ~F.col("nochk")
    claimant = F.col("claims") & banked
    row = weights.survey_facts(
        households(t),
        "wgt",
        {
            "deposit": (banked, F.col("any_card"), False),
            "banked": (F.col("claims"), F.col("nochk"), True),
            "any_card": (claimant, F.col("any_card"), False),
            "one_card": (claimant, F.col("one_card"), False),
        },
        derived={"outside": F.col("one_card") * (1 - ratio(F.lit(0.37), F.col("any_card"))) + F.col("any_card")},
    )
    return rounded(weights.facts_long(row), 6, "value")


@query(f"""
WITH {HOUSEHOLDS}, long AS (
  SELECT 'balance' AS measure, balance AS x, wgt FROM households UNION ALL SELECT 'weight', wgt, wgt FROM households),
c AS (SELECT *, sum(wgt) OVER (PARTITION BY measure ORDER BY x RANGE UNBOUNDED PRECEDING) AS cum, sum(wgt) OVER (PARTITION BY measure) AS tot FROM long)
SELECT measure, round_even(min(x) FILTER (cum >= 0.1 * tot), 0) AS p10, round_even(min(x) FILTER (cum >= 0.5 * tot), 0) AS p50,
       round_even(min(x) FILTER (cum >= 0.9 * tot), 0) AS p90, round_even(sum(x * wgt) / sum(wgt), 0) AS mean
FROM c GROUP BY 1""")
def weighted_summary(t: Tables):
    df = households(t).select("balance", F.col("wgt").alias("weight"), "wgt")
    return weights.weighted_summary(df, "wgt", ["balance", "weight"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query(f"""
WITH {HOUSEHOLDS}, b AS (
  SELECT CAST(CASE WHEN balance < 9000 THEN floor(balance / 500) * 500 ELSE 9000 END AS DOUBLE) AS bin, sum(wgt) AS weight
  FROM households WHERE balance >= 0 GROUP BY 1)
SELECT bin, weight, round(weight / (SELECT sum(weight) FROM b), 8) AS share FROM b""")
def binned_distribution(t: Tables):
    banked = households(t).filter("balance >= 0")
    return rounded(weights.binned_distribution(banked, "balance", "wgt", 500, top=9000), 8, "share").orderBy("bin")


MULTI = """
early AS (SELECT id, sum(n_orders) / count(*) AS wt, 12 * sum(amount) / count(*) AS spend, 12 * sum(benefit) / count(*) AS ben
          FROM months WHERE period <= 12 GROUP BY id),
dated AS (SELECT *, min(CASE WHEN benefit > 0 THEN period END) OVER (PARTITION BY id) AS first_date FROM months),
before AS (SELECT id, sum(n_orders) / count(*) AS wt, 12 * sum(amount) / count(*) AS spend FROM dated
           WHERE period >= first_date - 12 AND period < first_date GROUP BY id HAVING max(period) - min(period) >= 6),
e1 AS (SELECT CASE WHEN spend < 4000000 THEN floor(spend / 200000) * 200000 ELSE 4000000 END AS bin, sum(wt) AS wt FROM early GROUP BY 1),
e2 AS (SELECT CASE WHEN ben < 4000000 THEN floor(ben / 200000) * 200000 ELSE 4000000 END AS bin, sum(wt) AS wt FROM early GROUP BY 1),
b1 AS (SELECT CASE WHEN spend < 4000000 THEN floor(spend / 200000) * 200000 ELSE 4000000 END AS bin, sum(wt) AS wt FROM before GROUP BY 1)"""


@query(f"""
WITH {MONTHS}, {MULTI}
SELECT CAST(bin AS DOUBLE) AS bin, round(e1.wt, 6) AS wt_all_spend, round(e1.wt / (SELECT sum(wt) FROM e1), 6) AS pct_all_spend,
       round(e2.wt, 6) AS wt_all_benefit, round(e2.wt / (SELECT sum(wt) FROM e2), 6) AS pct_all_benefit,
       round(b1.wt, 6) AS wt_prior_spend, round(b1.wt / (SELECT sum(wt) FROM b1), 6) AS pct_prior_spend
FROM e1 FULL JOIN e2 USING (bin) FULL JOIN b1 USING (bin)""")
def multi_distribution(t: Tables):
    def yearly(column):
        return 12 * F.sum(column) / F.count(F.lit(1))

    weight = (F.sum("n_orders") / F.count(F.lit(1))).alias("wt")
    person_months = materialise(months(t), "months")
    early = person_months.filter("period <= 12").groupBy("id").agg(
        weight, yearly("amount").alias("spend"), yearly("benefit").alias("ben")
    )
    dated = panels.event_study(person_months.withColumn("ui", F.col("benefit") > 0), "id", "period", {"ui": "ui"})
    before = (
        dated.filter("period >= first_ui_date - 12 AND period < first_ui_date")
        .groupBy("id")
        .agg(weight, yearly("amount").alias("spend"), (F.max("period") - F.min("period")).alias("span"))
        .filter("span >= 6")
    )

    def bins(column):
        return floor_bin(F.col(column), 200000, top=4000000)

    out = weights.multi_distribution(
        [
            (early, "wt", {"all_spend": bins("spend"), "all_benefit": bins("ben")}),
            (before, "wt", {"prior_spend": bins("spend")}),
        ]
    )
    return rounded(out, 6, *[c for c in out.columns if c != "bin"])


@query("""
WITH s AS (
  SELECT CAST(substr(p_brand, 7) AS INTEGER) AS code, p_type AS grp, -round(sum(l_extendedprice * (1 - l_discount)), 2) AS dollars
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
c AS (SELECT code, -dollars AS dollars, grp FROM s WHERE grp <> 'PROMO' AND code NOT IN (11)),
m AS (SELECT * FROM c QUALIFY dollars = max(dollars) OVER (PARTITION BY code)),
l AS (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS code, arg_min(p_name, p_partkey) AS label FROM part GROUP BY 1)
SELECT code, dollars, round(dollars / 118018, 8) AS spend_month, grp, label FROM m LEFT JOIN l USING (code)""")
def code_spend(t: Tables):
    code = F.substring("p_brand", 7, 10).cast("int")
    spend = (
        part_spend(t)
        .join(t.part, F.col("p_partkey") == F.col("l_partkey"))
        .groupBy(code.alias("code"), F.rpad(F.nullif(F.col("p_type"), F.lit("PROMO")), 30, " ").alias("grp"))
        .agg((-F.round(F.sum("net"), 2)).alias("dollars"))
    )
    labels = t.part.groupBy(code.alias("code")).agg(F.min_by("p_name", "p_partkey").alias("label"))
    out = crosswalk.code_spend(
        spend, labels, code="code", dollars="dollars", group="grp", label="label", customer_months=118018, excluded=[11]
    )
    return rounded(out, 8, "spend_month")


@query("""
WITH m AS (SELECT p_brand AS category, min(p_size) AS line_1, max(p_size) AS line_2, nullif(arg_max(p_size, p_partkey), 20) AS line_3 FROM part GROUP BY 1),
l AS (SELECT category, line_1 AS line FROM m UNION ALL SELECT category, line_2 FROM m UNION ALL SELECT category, line_3 FROM m WHERE line_3 IS NOT NULL),
b AS (SELECT p_size AS line, round(sum(p_retailprice), 2) AS agg FROM part WHERE p_size <> 50 GROUP BY 1)
SELECT category, round(coalesce(sum(agg), 0) / 1500, 6) AS bench FROM l LEFT JOIN b USING (line) GROUP BY 1""")
def benchmark_lines(t: Tables):
    mapping = t.part.groupBy(F.col("p_brand").alias("category")).agg(
        F.min("p_size").alias("line_1"),
        F.max("p_size").alias("line_2"),
        F.nullif(F.max_by("p_size", "p_partkey"), F.lit(20)).alias("line_3"),
    )
    benchmark = t.part.filter("p_size <> 50").groupBy(F.col("p_size").alias("line")).agg(F.round(F.sum("p_retailprice"), 2).alias("agg"))
    out = crosswalk.benchmark_lines(
        mapping,
        benchmark,
        category="category",
        line_columns=["line_1", "line_2", "line_3"],
        line="line",
        amount="agg",
        name="bench",
        divisor=125 * 12,
    )
    return rounded(out, 6, "bench")


@query("""
SELECT o_orderpriority AS source, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS line,
       'order ' || o_orderkey AS item, o_totalprice AS amount FROM orders""")
def align_offset_rows(t: Tables):
    def cell(place, label, value):
        return F.struct((F.col("o_orderkey") * 3 + place).alias("place"), label.alias("label"), value.alias("value"))

    name = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    lines = F.array(
        cell(0, name, F.lit(None).cast("string")),
        cell(1, F.lit("Mean"), F.format_string("%,.2f", "o_totalprice")),
        cell(2, F.lit("Share"), F.lit("12.5")),
    )
    printed = t.orders.select(F.col("o_orderpriority").alias("source"), F.inline(lines))
    return crosswalk.align_offset_rows(
        printed, source="source", order="place", label="label", value="value", headings=["Mean", "Share", "SE"]
    )


STAGE_ONE = [
    ("SMALL", "SMALL", 0.3, "set"),
    ("SMALL", "MEDIUM", 0.1, "set"),
    ("MEDIUM", "SMALL", 0.7, "add"),
    ("MEDIUM", "MEDIUM", -0.1, "add"),
    ("LARGE", "ECONOMY", 0.25, "add"),
    ("ECONOMY", "ECONOMY", -0.25, "add"),
    ("PROMO", "NOTHING", 1.0, "set"),
]
STAGE_TWO = [("LARGE", "LARGE", 0.14, "set"), ("STANDARD", "LARGE", 0.86, "add")]
RULES = ["category", "source", "coef", "mode"]

REALLOCATED = """,
one AS (SELECT category, CASE category
    WHEN 'SMALL' THEN 0.3 * (SELECT amount FROM category_spend WHERE category = 'SMALL') + 0.1 * (SELECT amount FROM category_spend WHERE category = 'MEDIUM')
    WHEN 'MEDIUM' THEN amount + 0.7 * (SELECT amount FROM category_spend WHERE category = 'SMALL') - 0.1 * amount
    WHEN 'LARGE' THEN amount + 0.25 * (SELECT amount FROM category_spend WHERE category = 'ECONOMY')
    WHEN 'ECONOMY' THEN amount - 0.25 * amount WHEN 'PROMO' THEN NULL ELSE amount END AS amount FROM category_spend),
two AS (SELECT category, CASE category WHEN 'LARGE' THEN 0.14 * amount
    WHEN 'STANDARD' THEN amount + 0.86 * (SELECT amount FROM one WHERE category = 'LARGE') ELSE amount END AS amount FROM one)"""


def reallocated(t: Tables):
    amounts = materialise(category_spend(t), "amounts")
    for stage in (STAGE_ONE, STAGE_TWO):
        rules = reshape.literal_table(t.spark, RULES, stage)
        sources = amounts.withColumnRenamed("category", "source")
        amounts = crosswalk.reallocate(amounts, sources, rules, "category", "amount")
    return amounts


@query(f"WITH {CATEGORY_SPEND}{REALLOCATED} SELECT category, round(amount, 4) AS amount FROM two")
def reallocate(t: Tables):
    return rounded(reallocated(t), 4, "amount")


@query(f"""
WITH {CATEGORY_SPEND},
s AS (SELECT CASE WHEN category IN ('SMALL', 'MEDIUM') THEN 'COMPACT' ELSE category END AS category, sum(amount) AS spend FROM category_spend GROUP BY 1),
b AS (SELECT CASE WHEN category IN ('SMALL', 'MEDIUM') THEN 'COMPACT' ELSE category END AS category, sum(amount) AS bench FROM benchmark_spend WHERE category <> 'PROMO' GROUP BY 1)
SELECT CASE WHEN category = 'COMPACT' THEN 'ND' WHEN category = 'PROMO' THEN 'Others' ELSE 'D' END AS grp, category,
       round_even(spend, 0) AS spend, round_even(bench, 0) AS bench, round_even(spend / (SELECT sum(spend) FROM s), 2) AS share_spend,
       round_even(spend / bench, 2) AS ratio_spend_bench, CASE WHEN category = 'COMPACT' THEN 1 WHEN category = 'PROMO' THEN 3 ELSE 2 END AS sort_key
FROM s LEFT JOIN b USING (category)""")
def coverage_table(t: Tables):
    merge = {"COMPACT": ["SMALL", "MEDIUM"]}
    category = F.col("category")
    options = (
        t.part.select(reshape.collapsed(F.col("p_type"), merge).alias("category"))
        .distinct()
        .select(F.when(category == "COMPACT", "ND").when(category == "PROMO", "Others").otherwise("D").alias("grp"), "category")
    )
    return crosswalk.coverage_table(
        options,
        {
            "spend": category_spend(t).withColumnRenamed("amount", "spend"),
            "bench": benchmark_spend(t).filter(category != "PROMO").withColumnRenamed("amount", "bench"),
        },
        category="category",
        group="grp",
        group_levels=["ND", "D", "Others"],
        ratios={"ratio_spend_bench": ("spend", "bench")},
        shares={"share_spend": "spend"},
        merge=merge,
    )


PAY = {"Cash": "1-URGENT", "Card": ["2-HIGH", "3-MEDIUM"], "Check": "4-NOT SPECIFIED", "Transfer": "5-LOW"}
KIND = {"strict": ["AF", "AO"], "nondurable": "NF", "durable": ["NO", "RF"], "taxes": "RO"}
SHARE_TEXT = "CAST(CAST(round_even(100 * {x}, 0) AS INTEGER) AS VARCHAR) || '%'"


@query(f"""
WITH {DIARY}, d AS (
  SELECT *, amount * 31 / (max(day) OVER (PARTITION BY person) - min(day) OVER (PARTITION BY person) + 1) AS a FROM diary),
c AS (SELECT CASE pay_code WHEN '1-URGENT' THEN 'Cash' WHEN '4-NOT SPECIFIED' THEN 'Check' WHEN '5-LOW' THEN 'Transfer' ELSE 'Card' END AS payment,
  CASE WHEN merch_code IN ('AF', 'AO') THEN 'strict' WHEN merch_code = 'NF' THEN 'nondurable' WHEN merch_code IN ('NO', 'RF') THEN 'durable' ELSE 'taxes' END AS kind,
  a * ind_weight * 2.0445 / (SELECT count(DISTINCT person) FROM diary) AS v FROM d),
w AS (SELECT payment, round(sum(v) FILTER (kind = 'strict'), 2) AS s, round(sum(v) FILTER (kind = 'nondurable'), 2) AS n,
  round(sum(v) FILTER (kind = 'durable'), 2) AS d, round(sum(v) FILTER (kind = 'taxes'), 2) AS x FROM c GROUP BY 1),
a AS (SELECT * FROM w UNION ALL SELECT 'Total', sum(s), sum(n), sum(d), sum(x) FROM w),
r AS (SELECT payment, (s + n) / (s + n + d + x) AS nd, d / (s + n + d + x) AS du FROM a)
SELECT payment, {SHARE_TEXT.format(x="nd")} AS nondurable_share, {SHARE_TEXT.format(x="du")} AS durable_share,
       {SHARE_TEXT.format(x="(nd + du)")} AS consump_share, {SHARE_TEXT.format(x="(1 - (nd + du))")} AS other_share,
       CAST(list_position(['Cash', 'Card', 'Check', 'Transfer', 'Total'], payment) AS INTEGER) AS sort_key FROM r""")
def payment_mix(t: Tables):
    return crosswalk.payment_mix(
        diary(t),
        person="person",
        day="day",
        amount="amount",
        weight="ind_weight",
        payment=reshape.collapsed(F.col("pay_code"), PAY),
        category=reshape.collapsed(F.col("merch_code"), KIND),
        payment_levels=list(PAY),
        category_levels=list(KIND),
        nondurable=["strict", "nondurable"],
        durable=["durable"],
        base=list(KIND),
        scale=2.0445,
    )


@query(f"""
WITH {DIARY}, c AS (
  SELECT CASE WHEN merch_code IN ('AF', 'AO') THEN 'strict' WHEN merch_code = 'NF' THEN 'nondurable' WHEN merch_code IN ('NO', 'RF') THEN 'durable' ELSE 'taxes' END AS category,
         sum(amount * ind_weight) * 2.0445 AS total FROM diary GROUP BY 1)
SELECT category, round_even(total / (SELECT sum(total) FROM c), 3) AS ratio,
       CAST(list_position(['strict', 'nondurable', 'durable', 'taxes'], category) AS INTEGER) AS sort_key FROM c""")
def category_share(t: Tables):
    level = reshape.collapsed(F.col("merch_code"), KIND)
    return crosswalk.category_share(
        diary(t), level=level, amount="amount", weight="ind_weight", scale=2.0445, levels=list(KIND)
    )


@query("""
SELECT c_custkey, n_nationkey, CASE WHEN n_regionkey IN (0, 2) THEN 'Yes' ELSE 'No' END AS served
FROM (SELECT c_custkey, c_nationkey AS n_nationkey FROM customer) LEFT JOIN nation USING (n_nationkey)""")
def region_flag(t: Tables):
    attributes = t.nation.withColumn("branch", F.when(F.col("n_regionkey").isin(0, 2), "Y").otherwise("N"))
    outlines = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return crosswalk.region_flag(outlines, attributes, "n_nationkey", yes_no(F.col("branch")), "served")


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY 1")
def currency_group_mean(t: Tables):
    shown = t.part.select("p_brand", F.format_string("$%,.2f ", "p_retailprice").alias("price"))
    return rounded(crosswalk.currency_group_mean(shown, "p_brand", "price", "mean_price"), 6, "mean_price")
