"""Equi joins; sides are broadcast only when Spark's own size check says so."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.numbers import floor_bin, ratio
from tallyframe.operators.attach import attach
from tallyframe.plans.inputs import HOUSEHOLDS, MONTHS, PRICES, households, months, prices
from tallyframe.plans.registry import Tables, query, rounded
from tallyframe.session import materialise


@query("""
SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey""")
def join_inner(t: Tables):
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", "c_mktsegment", "o_totalprice"
    )


@query(f"""
WITH {MONTHS}, last AS (SELECT id AS pid, max(period) AS last_period FROM months GROUP BY 1)
SELECT id, period, amount FROM last JOIN months ON id = pid AND period = last_period""")
def join_inner_multi(t: Tables):
    panel = months(t)
    last = panel.groupBy(F.col("id").alias("pid")).agg(F.max("period").alias("last_period"))
    on = (F.col("id") == F.col("pid")) & (F.col("period") == F.col("last_period"))
    return last.join(panel, on).select("id", "period", "amount")


@query("""
SELECT c_custkey, count(o_orderkey) AS n_urgent FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def join_left(t: Tables):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("n_urgent")
    )


@query("""
SELECT nation, coalesce(n_rich, 0) AS n_rich, coalesce(n_supply, 0) AS n_supply FROM
  (SELECT c_nationkey AS nation, count(*) AS n_rich FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
  FULL JOIN (SELECT s_nationkey AS nation, count(*) AS n_supply FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) USING (nation)""")
def join_full(t: Tables):
    rich = t.customer.filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_rich"))
    supply = t.supplier.filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_supply"))
    return rich.join(supply, "nation", "full").fillna(0)


@query("""
SELECT n_nationkey AS nation, r_name, c.n_cust, s.n_supp, round(o.total, 2) AS total
FROM nation JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS n_cust FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n_supp FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey AS k, sum(o_totalprice) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) o ON o.k = n_nationkey""")
def join_star(t: Tables):
    customers = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_cust"))
    suppliers = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_supp"))
    by_customer = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    spent = (
        by_customer.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(F.col("c_nationkey").alias("nation"))
        .agg(F.sum("spent").alias("total"))
    )
    options = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_nationkey").alias("nation"), "r_name"
    )
    star = options.join(customers, "nation", "left").join(suppliers, "nation", "left").join(spent, "nation", "left")
    return rounded(star, 2, "total")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR p_brand = 'Brand#4')""")
def join_semi(t: Tables):
    listed = t.part.filter((F.col("p_type") == "PROMO") | (F.col("p_brand") == "Brand#4"))
    return t.lineitem.join(listed, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    )


@query("""
SELECT c_custkey, c_nationkey FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""")
def join_anti(t: Tables):
    big = t.orders.filter("o_totalprice > 450000")
    return t.customer.join(big, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query(f"""
WITH {MONTHS}, {PRICES}
SELECT id, period, round(amount / price, 6) AS in_units FROM months LEFT JOIN prices ON period = month_cal""")
def join_period(t: Tables):
    # written, so that Spark knows the size of the price table when it picks the join
    monthly = materialise(prices(t), "prices")
    joined = months(t).join(monthly, F.col("period") == F.col("month_cal"), "left")
    return rounded(joined.select("id", "period", ratio(F.col("amount"), F.col("price")).alias("in_units")), 6, "in_units")


@query(f"""
WITH {HOUSEHOLDS}
SELECT id, nation, round(balance * wgt / sum(wgt) OVER (PARTITION BY nation), 6) AS part FROM households""")
def join_agg_back(t: Tables):
    with_total = attach(households(t), ["nation"], [F.sum("wgt").alias("total")], spread=["id"])
    return rounded(
        with_total.select("id", "nation", ratio(F.col("balance") * F.col("wgt"), F.col("total")).alias("part")), 6, "part"
    )


@query("""
SELECT bin, n_cust, n_supp FROM
  (SELECT floor(c_acctbal / 500) * 500 AS bin, count(*) AS n_cust FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
  FULL JOIN (SELECT floor(s_acctbal / 500) * 500 AS bin, count(*) AS n_supp FROM supplier GROUP BY 1) USING (bin)""")
def join_bins(t: Tables):
    left = t.customer.filter(F.col("c_mktsegment") == "BUILDING").groupBy(floor_bin(F.col("c_acctbal"), 500).alias("bin"))
    right = t.supplier.groupBy(floor_bin(F.col("s_acctbal"), 500).alias("bin"))
    return left.agg(F.count(F.lit(1)).alias("n_cust")).join(right.agg(F.count(F.lit(1)).alias("n_supp")), "bin", "full")
