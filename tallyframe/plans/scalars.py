"""Scalar functions and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import arrays, numbers, text
from tallyframe.operators import quality, reshape
from tallyframe.operators.history import state_counts
from tallyframe.operators.weights import facts_long, survey_facts
from tallyframe.plans.inputs import HISTORY, HOUSEHOLDS, TARGETS, TYPES, history, households, part_spend, targets, types
from tallyframe.plans.registry import Tables, query, rounded


@query("SELECT c_custkey, substr(c_name, 10) AS number, substr(c_mktsegment, 2) AS tail FROM customer")
def str_substring(t: Tables):
    return t.customer.select(
        "c_custkey", text.suffix_from(F.col("c_name"), 10).alias("number"), text.suffix_from(F.col("c_mktsegment"), 2).alias("tail")
    )


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, concat(l_orderkey, l_linenumber, nullif(l_returnflag, 'N')) AS key FROM lineitem""")
def str_concat(t: Tables):
    key = text.pasted(F.col("l_orderkey"), F.col("l_linenumber"), F.nullif(F.col("l_returnflag"), F.lit("N")))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", key.alias("key"))


@query("SELECT p_partkey, CASE WHEN p_size <> 50 THEN p_retailprice END AS price FROM part")
def parse_currency(t: Tables):
    shown = F.when(F.col("p_size") == 50, F.lit("n/a")).otherwise(F.format_string("$%,.2f ", "p_retailprice"))
    return t.part.select("p_partkey", text.money_to_double(shown).alias("price"))


@query("SELECT p_partkey, p_type AS kind FROM part")
def str_trim(t: Tables):
    return t.part.select("p_partkey", F.trim(F.rpad("p_type", 20, " ")).alias("kind"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, CAST(CAST(round_even(l_discount * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS discount FROM lineitem""")
def fmt_percent(t: Tables):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", text.percent_text(F.col("l_discount")).alias("discount"))


@query("""
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(year(o_orderdate) AS INTEGER) AS y,
       CAST(month(o_orderdate) AS INTEGER) AS m, strftime(o_orderdate, '%m') AS mm FROM orders""")
def date_parts(t: Tables):
    shown = F.date_format("o_orderdate", "M/d/yyyy")
    day = F.to_date(shown, "M/d/yyyy")
    return t.orders.select("o_orderkey", day.alias("d")).select(
        "o_orderkey", F.col("d").cast("string").alias("day"), F.year("d").alias("y"), F.month("d").alias("m"), F.date_format("d", "MM").alias("mm")
    )


@query("""
SELECT o_orderkey, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS calendar,
       CAST((w - 1) * 4 + r AS INTEGER) AS by_wave
FROM (SELECT *, CAST(floor((month(o_orderdate) - 1) / 4) + 1 AS INTEGER) AS w, (month(o_orderdate) - 1) % 4 + 1 AS r FROM orders)""")
def month_index(t: Tables):
    month = F.month("o_orderdate")
    wave, ref = numbers.wave_of(month - 1), (month - 1) % 4 + 1
    return t.orders.select(
        "o_orderkey",
        numbers.month_index(F.year("o_orderdate"), month, 1995).alias("calendar"),
        numbers.wave_month_index(wave, ref).alias("by_wave"),
    )


@query("""
SELECT c_custkey, floor(c_acctbal / 500) * 500 AS bin, CAST(floor(c_custkey / 4) + 1 AS INTEGER) AS wave,
       CAST(4 * floor((c_custkey - 100) / 4) AS INTEGER) AS rel FROM customer""")
def floor_bin(t: Tables):
    return t.customer.select(
        "c_custkey",
        numbers.floor_bin(F.col("c_acctbal"), 500).alias("bin"),
        numbers.wave_of(F.col("c_custkey")).alias("wave"),
        numbers.wave_start(F.col("c_custkey") - 100).alias("rel"),
    )


@query("SELECT l_orderkey, l_partkey, l_suppkey, round_even(l_quantity / 2, 0) AS half FROM lineitem")
def round_even(t: Tables):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.bround(F.col("l_quantity") / 2, 0).alias("half"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'none' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS level,
       CASE WHEN c_nationkey < 4 THEN c_nationkey ELSE 4 END AS topped FROM customer""")
def case_when(t: Tables):
    balance = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey",
        F.when(balance < 0, "none").when(balance < 5000, "some").otherwise("much").alias("level"),
        numbers.capped(F.col("c_nationkey"), 4).alias("topped"),
    )


@query("""
SELECT CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'compact' WHEN p_type = 'PROMO' THEN 'sale' ELSE p_type END AS kind,
       count(*) AS n, round(sum(l_extendedprice), 2) AS spend FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def level_collapse(t: Tables):
    mapping = t.part.select("p_type").distinct().select(
        F.col("p_type").alias("old"), F.when(F.col("p_type").isin("SMALL", "MEDIUM"), "compact").when(F.col("p_type") == "PROMO", "sale").alias("new")
    ).dropna()
    rows = part_spend(t).join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_type").alias("kind"), "n", "gross")
    spend = rows.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("gross").alias("spend"))
    few = reshape.mapped_levels(spend, "kind", mapping).groupBy("kind").agg(F.sum("n").alias("n"), F.sum("spend").alias("spend"))
    return rounded(few, 2, "spend")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' ELSE l_returnflag END AS flag,
       CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE 'No' END AS is_open FROM lineitem""")
def level_recode(t: Tables):
    return t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        reshape.recoded(F.col("l_returnflag"), {"A": "Accepted", "R": "Returned"}).alias("flag"),
        text.yes_no(F.col("l_linestatus"), "O").alias("is_open"),
    )


@query("SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '[0-9]+'), '') AS DOUBLE) AS k, CASE WHEN event_type <> 'error' THEN value END AS v FROM events")
def lenient_cast(t: Tables):
    shown = F.when(F.col("event_type") == "error", F.lit("--")).otherwise(F.col("value").cast("string"))
    k = F.regexp_replace("props", "[^0-9]", "")
    return t.events.select("event_id", text.lenient_double(k).alias("k"), text.lenient_double(shown).alias("v"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_tax / nullif(l_discount, 0) AS r FROM lineitem")
def safe_ratio(t: Tables):
    r = numbers.ratio(F.col("l_tax"), F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", r.alias("r"))


@query("""
SELECT event_id, round(pow(c, -1.0) / -1.0, 6) AS u, round(pow(c, -2.0), 6) AS mu, round(3.0 * pow(s, 2.5) / 2.5, 6) AS cost
FROM (SELECT event_id, 1 + value / 100 AS c, value / 1000 AS s FROM events)""")
def power_utility(t: Tables):
    c, s = 1 + F.col("value") / 100, F.col("value") / 1000
    out = t.events.select(
        "event_id",
        numbers.isoelastic(c, 2.0).alias("u"),
        numbers.marginal_isoelastic(c, 2.0).alias("mu"),
        numbers.effort_cost(s, 3.0, 1.5).alias("cost"),
    )
    return rounded(out, 6, "u", "mu", "cost")


@query("""
WITH v AS (SELECT event_id, value, value / 2 AS half, value + 1 AS more FROM events)
SELECT event_id, CAST(p AS INTEGER) AS position,
       round(CASE p WHEN 0 THEN value / more WHEN 1 THEN 1.0 ELSE half / more END, 6) AS target,
       round(CASE p WHEN 1 THEN half WHEN 2 THEN more END, 6) AS padded
FROM v, (VALUES (0), (1), (2)) AS t(p)""")
def series_align(t: Tables):
    value = F.col("value")
    long_, short = F.array(F.lit(0.0), value, value + 1, value / 2), F.array(value / 2, value + 1)
    target = arrays.normalised(arrays.cut(long_, 1, 3), 1)
    both = F.arrays_zip(target.alias("target"), arrays.padded_front(short, F.lit(3)).alias("padded"))
    rows = t.events.select("event_id", F.posexplode(both).alias("position", "cell"))
    return rounded(rows.select("event_id", "position", "cell.target", "cell.padded"), 6, "target", "padded")


@query(f"""
WITH {TYPES}, {TARGETS}
SELECT series, period, value - 1.96 * se AS low, value + 1.96 * se AS high,
       ((value + 1.96 * se) - (value - 1.96 * se)) / 3.92 AS se_back FROM targets""")
def confidence_band(t: Tables):
    low, high = numbers.band(F.col("value"), F.col("se"))
    bands = targets(t).select("series", "period", low.alias("low"), high.alias("high"))
    return bands.withColumn("se_back", numbers.se_from_band(F.col("low"), F.col("high")))


@query(f"""
WITH {HOUSEHOLDS}, facts AS (
  SELECT 'claiming' AS fact, CAST(CAST(round_even(100 * sum(wgt) FILTER (claims) / sum(wgt), 0) AS INTEGER) AS VARCHAR) || '%' AS actual, '20%' AS expected FROM households
  UNION ALL SELECT 'banked', CAST(CAST(round_even(100 * (1 - sum(wgt) FILTER (nochk) / sum(wgt)), 0) AS INTEGER) AS VARCHAR) || '%', '75%' FROM households)
SELECT fact, actual, expected, actual = expected AS pass FROM facts""")
def check_expected(t: Tables):
    everyone = F.lit(True)
    row = survey_facts(
        households(t), "wgt", {"claiming": (everyone, F.col("claims"), False), "banked": (everyone, F.col("nochk"), True)}
    )
    expected = facts_long(row.select(*[F.lit(e).alias(f) for f, e in (("claiming", "20%"), ("banked", "75%"))]), "fact", "expected")
    return quality.check_expected(facts_long(row), expected, "fact", text.percent_text(F.col("value")))


@query(f"""
WITH {HISTORY}, counts AS (SELECT agent, state, count(*) AS n FROM history GROUP BY 1, 2),
shares AS (SELECT agent, state, n / sum(n) OVER (PARTITION BY agent) AS share FROM counts)
SELECT agent, round(sum(share), 6) AS total, abs(sum(share) - 1) < 1e-8 AS pass FROM shares GROUP BY 1""")
def check_sum_to_one(t: Tables):
    shares = state_counts(history(t), ["agent"], "state")
    return rounded(quality.check_sum_to_one(shares, ["agent"], "share"), 6, "total")


@query(f"""
WITH {TYPES}, {TARGETS}, a AS (SELECT DISTINCT series, period FROM targets),
b AS (SELECT DISTINCT type AS series, period + 1 AS period FROM types)
SELECT count(*) FILTER (b.series IS NULL) AS only_left, count(*) FILTER (a.series IS NULL) AS only_right,
       count(*) FILTER (a.series IS NULL OR b.series IS NULL) = 0 AS pass
FROM a FULL JOIN b ON a.series = b.series AND a.period = b.period""")
def check_aligned(t: Tables):
    shifted = types(t).select(F.col("type").alias("series"), (F.col("period") + 1).alias("period"))
    return quality.check_aligned(targets(t), shifted, ["series", "period"])
