"""Aggregations, weighted statistics and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.numbers import floor_bin
from tallyframe.operators import crosswalk, reshape, weights
from tallyframe.operators.attach import first_rows, keep_groups, rows_at_max, rows_like_first
from tallyframe.plans.inputs import DIARY, HISTORY, HOUSEHOLDS, MONTHS, diary, history, households, months
from tallyframe.plans.registry import Tables, query, rounded
from tallyframe.session import materialise


@query("SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders")
def agg_global(t: Tables):
    out = t.orders.agg(F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).alias("n"))
    return rounded(rounded(out, 2, "total"), 4, "mean")


@query("""
SELECT l_suppkey, round(coalesce(sum(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END), 0), 2) AS returned
FROM lineitem GROUP BY 1""")
def agg_group_sum(t: Tables):
    some = F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))
    return rounded(t.lineitem.groupBy("l_suppkey").agg(F.coalesce(F.sum(some), F.lit(0.0)).alias("returned")), 2, "returned")


@query("SELECT l_partkey, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1")
def agg_group_mean(t: Tables):
    return rounded(t.lineitem.groupBy("l_partkey").agg(F.avg("l_quantity").alias("mean_quantity")), 6, "mean_quantity")


@query(f"""
WITH {HOUSEHOLDS}
SELECT segment, round(sum(bal * wgt) / sum(CASE WHEN bal IS NOT NULL THEN wgt END), 4) AS balance,
       round(sum(CAST(any_card AS INTEGER) * wgt) / sum(wgt), 6) AS any_card
FROM (SELECT *, CASE WHEN balance >= 0 THEN balance END AS bal FROM households) GROUP BY 1""")
def weighted_mean(t: Tables):
    df = households(t).withColumn("balance", F.when(F.col("balance") >= 0, F.col("balance")))
    return rounded(rounded(weights.weighted_means(df, ["segment"], ["balance", "any_card"], "wgt"), 4, "balance"), 6, "any_card")


@query(f"""
WITH {HOUSEHOLDS}
SELECT nation, round(sum(wgt * claims::INT) / sum(wgt), 6) AS claiming, round(1 - sum(wgt * nochk::INT) / sum(wgt), 6) AS banked
FROM households GROUP BY 1""")
def weighted_share(t: Tables):
    out = households(t).groupBy("nation").agg(
        weights.weighted_share(F.col("claims"), F.col("wgt")).alias("claiming"),
        weights.weighted_share(F.col("nochk"), F.col("wgt"), complement=True).alias("banked"),
    )
    return rounded(out, 6, "claiming", "banked")


WEIGHTED_QUANTILE = """
SELECT {keys} {picks} FROM (
  SELECT *, sum(wgt) OVER (PARTITION BY {by} ORDER BY {value} RANGE UNBOUNDED PRECEDING) AS cum,
         sum(wgt) OVER (PARTITION BY {by}) AS tot FROM {source}) GROUP BY {by}"""


def pick(value: str, q: float, name: str) -> str:
    return f"min({value}) FILTER (cum >= {q} * tot) AS {name}"


@query(
    f"WITH {HOUSEHOLDS}"
    + WEIGHTED_QUANTILE.format(
        keys="segment,",
        by="segment",
        value="balance",
        source="households",
        picks=", ".join([pick("balance", 0.1, "p10"), pick("balance", 0.5, "p50"), pick("balance", 0.9, "p90")]),
    )
)
def weighted_quantile(t: Tables):
    return weights.weighted_quantiles(households(t), ["segment"], "balance", "wgt", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query(
    f"WITH {MONTHS}, m AS (SELECT period, amount, CAST(n_orders AS DOUBLE) AS wgt FROM months)"
    + WEIGHTED_QUANTILE.format(keys="period,", by="period", value="amount", source="m", picks=pick("amount", 0.5, "median"))
)
def weighted_median(t: Tables):
    return weights.weighted_quantiles(months(t), ["period"], "amount", "n_orders", {"median": 0.5})


@query("""
SELECT CAST(CASE WHEN l_extendedprice < 5000 THEN 5000 WHEN l_extendedprice < 80000 THEN floor(l_extendedprice / 2500) * 2500
       ELSE 80000 END AS DOUBLE) AS bin, sum(l_quantity) AS weight FROM lineitem GROUP BY 1""")
def weighted_histogram(t: Tables):
    return weights.weighted_histogram(t.lineitem, "l_extendedprice", "l_quantity", 2500, top=80000, bottom=5000)


@query("""
SELECT l_suppkey, round(sum(l_extendedprice), 2) AS spend, round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem), 8) AS share
FROM lineitem GROUP BY 1""")
def share_of_total(t: Tables):
    spend = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("spend"))
    return rounded(rounded(weights.share_of_total(spend, "spend"), 8, "share"), 2, "spend")


@query("""
SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1""")
def count_distinct(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_customers")
    )


@query("""
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_f,
       round(coalesce(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 0) / 12, 4) AS urgent_monthly
FROM orders GROUP BY 1""")
def agg_conditional(t: Tables):
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).otherwise(0.0)
    out = t.orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), (F.sum(urgent) / 12).alias("urgent_monthly")
    )
    return rounded(out, 4, "urgent_monthly")


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1""")
def distinct_first(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice")
    return first_rows(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem
QUALIFY l_quantity = max(l_quantity) OVER (PARTITION BY l_suppkey)""")
def argmax_ties(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return rows_at_max(rows, ["l_suppkey"], "l_quantity")


@query("""
SELECT o_custkey, o_orderkey, o_orderpriority FROM orders
QUALIFY o_orderpriority = first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def first_value_filter(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority")
    return rows_like_first(rows, ["o_custkey"], "o_orderpriority", ["o_orderkey"], spread=["o_orderkey"])



@query("""
SELECT o_custkey, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O,
       round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P
FROM orders GROUP BY 1""")
def pivot_wide(t: Tables):
    return reshape.wide(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O", "P"], F.sum("o_totalprice"), round_to=2)


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, kind, amount FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'l_discount' AS kind, nullif(l_discount, 0) AS amount FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'l_tax', nullif(l_tax, 0) FROM lineitem)
WHERE amount IS NOT NULL""")
def unpivot_long(t: Tables):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = t.lineitem.select(*keys, *[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in ("l_discount", "l_tax")])
    return reshape.long(rows, keys, ["l_discount", "l_tax"], "kind", "amount")


@query("""
SELECT coalesce(o_orderpriority, 'Total') AS payment, round(sum(o_totalprice), 2) AS spend, sum(n)::BIGINT AS n
FROM (SELECT o_orderpriority, o_totalprice, 1 AS n FROM orders) GROUP BY ROLLUP (o_orderpriority)""")
def total_row(t: Tables):
    table = t.orders.groupBy(F.col("o_orderpriority").alias("payment")).agg(
        F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("n")
    )
    return rounded(reshape.total_row(table, "payment", ["spend", "n"]), 2, "spend")


@query("""
SELECT o_orderkey, o_custkey FROM orders
QUALIFY count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) = 4""")
def group_filter(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    kept = keep_groups(rows, ["o_custkey"], F.count_if(F.col("o_orderstatus") == "F") == 4, spread=["o_orderkey"])
    return kept.drop("o_orderstatus")


@query("""
SELECT o_orderkey, o_totalprice * 31 / (max(dayofyear(o_orderdate)) OVER w - min(dayofyear(o_orderdate)) OVER w + 1) AS monthly
FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def rate_rescale(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", F.dayofyear("o_orderdate").alias("day"), "o_totalprice")
    scaled = crosswalk.rate_rescaled(rows, "o_custkey", "day", "o_totalprice", 31, "monthly", spread=["o_orderkey"])
    return scaled.select("o_orderkey", "monthly")


@query(f"""
WITH {DIARY}
SELECT pay_code, round(sum(amount * ind_weight), 2) * 2.5 / (SELECT count(DISTINCT person) FROM diary) AS total FROM diary GROUP BY 1""")
def population_total(t: Tables):
    # one row per person and payment, read for the sums and for the head count
    cells = materialise(
        diary(t).groupBy("pay_code", "person", "ind_weight").agg(F.round(F.sum("amount"), 2).alias("amount")), "cells"
    )
    people = cells.agg(F.count_distinct("person"))
    sums = cells.groupBy("pay_code").agg(weights.population_total(F.col("amount"), F.col("ind_weight"), 1.0).alias("total"))
    return sums.select("pay_code", (F.round("total", 2) * 2.5 / people.scalar()).alias("total"))


@query(f"""
WITH {MONTHS}
SELECT id, n_months, round(12 * total / n_months, 4) AS yearly,
       CAST(CASE WHEN 12 * total / n_months < 3000000 THEN floor(12 * total / n_months / 100000) * 100000 ELSE 3000000 END AS DOUBLE) AS bin
FROM (SELECT id, count(*) AS n_months, sum(amount) AS total FROM months GROUP BY 1)""")
def agg_multi_expr(t: Tables):
    sums = months(t).groupBy("id").agg(F.count(F.lit(1)).alias("n_months"), F.sum("amount").alias("total"))
    yearly = F.lit(12) * F.col("total") / F.col("n_months")
    out = sums.select("id", "n_months", yearly.alias("yearly"), floor_bin(yearly, 100000, top=3000000).alias("bin"))
    return rounded(out, 4, "yearly")


@query("""
SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75 FROM events GROUP BY 1""")
def percentiles(t: Tables):
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    return rounded(
        weights.weighted_quantiles(t.events, ["event_type"], "value", None, probs, interpolate=True), 6, *probs
    )


@query(f"WITH {HISTORY} SELECT state, round(avg(cons), 6) AS mean_cons FROM history GROUP BY 1")
def mean_by_state(t: Tables):
    return rounded(history(t).groupBy("state").agg(F.avg("cons").alias("mean_cons")), 6, "mean_cons")
