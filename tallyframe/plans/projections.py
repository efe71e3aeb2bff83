"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.numbers import ratio
from tallyframe.operators.ordered import in_pieces, numbered
from tallyframe.operators.reshape import map_columns as change_columns
from tallyframe.plans.registry import Tables, query, rounded


@query("SELECT c_mktsegment AS segment, c_custkey AS id, c_acctbal FROM customer")
def project_cols(t: Tables):
    return t.customer.drop("c_name", "c_nationkey").withColumnsRenamed(
        {"c_custkey": "id", "c_mktsegment": "segment"}
    ).select("segment", "id", "c_acctbal")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, net, gross, gross / l_quantity AS unit
FROM (SELECT *, net * (1 + l_tax) AS gross FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem))""")
def derive_seq(t: Tables):
    return (
        t.lineitem.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
        .withColumn("gross", F.col("net") * (1 + F.col("l_tax")))
        .withColumn("unit", ratio(F.col("gross"), F.col("l_quantity")))
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "net", "gross", "unit")
    )


@query("""
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 15000 AND o_orderpriority IS NOT NULL""")
def filter_pred(t: Tables):
    kept = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 15000) & F.col("o_orderpriority").isNotNull()
    return t.orders.filter(kept).select("o_orderkey", "o_totalprice")


@query("""
SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')""")
def filter_isin(t: Tables):
    return t.orders.filter(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P")
    ).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN value END, 0) AS value FROM events")
def null_default(t: Tables):
    gaps = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return gaps.fillna(0.0, ["value"])


@query("""
SELECT p_partkey, nullif(p_size, 50) AS p_size, CASE WHEN p_retailprice >= 1000 THEN p_retailprice END AS price FROM part""")
def null_sentinel(t: Tables):
    return t.part.select(
        "p_partkey",
        F.nullif(F.col("p_size"), F.lit(50)).alias("p_size"),
        F.when(F.col("p_retailprice") >= 1000, F.col("p_retailprice")).alias("price"),
    )


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING'")
def drop_incomplete(t: Tables):
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
    ).dropna("any")


@query("""
SELECT o_orderstatus, round_even(avg(o_totalprice), 0) AS spend_mean, round_even(max(o_totalprice), 0) AS spend_max, count(*) AS n
FROM orders GROUP BY 1""")
def map_columns(t: Tables):
    sums = t.orders.groupBy("o_orderstatus").agg(
        F.avg("o_totalprice").alias("spend_mean"), F.max("o_totalprice").alias("spend_max"), F.count(F.lit(1)).alias("n")
    )
    return change_columns(sums, lambda c: c.startswith("spend"), lambda c: F.bround(c, 0))


@query("""
WITH s AS (SELECT o_orderpriority, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT o_orderpriority, round(total / (SELECT total FROM s WHERE o_orderpriority = '1-URGENT'), 6) AS to_urgent,
       round(total / (SELECT sum(s_acctbal) FROM supplier WHERE s_acctbal > 0), 6) AS to_supply
FROM s""")
def scalar_lookup(t: Tables):
    total = F.sum("o_totalprice")
    sums = t.orders.groupBy("o_orderpriority").agg(total.alias("total"))
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").agg(total)
    supply = t.supplier.filter("s_acctbal > 0").agg(F.sum("s_acctbal"))
    out = sums.select(
        "o_orderpriority",
        ratio(F.col("total"), urgent.scalar()).alias("to_urgent"),
        ratio(F.col("total"), supply.scalar()).alias("to_supply"),
    )
    return rounded(out, 6, "to_urgent", "to_supply")


@query("""
WITH s AS (SELECT p_type AS category, round(sum(p_retailprice), 2) AS spend FROM part GROUP BY 1)
SELECT category, spend FROM s
UNION ALL SELECT 'FLIGHTS', round(0.64 * spend, 2) FROM s WHERE category = 'PROMO'""")
def append_row(t: Tables):
    spend = t.part.groupBy(F.col("p_type").alias("category")).agg(F.round(F.sum("p_retailprice"), 2).alias("spend"))
    promo = t.part.filter(F.col("p_type") == "PROMO").agg(F.round(F.sum("p_retailprice"), 2).alias("spend"))
    row = promo.select(F.lit("FLIGHTS").alias("category"), F.round(0.64 * F.col("spend"), 2).alias("spend"))
    return spend.unionByName(row)


@query("""
SELECT o_orderpriority AS source, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS line
FROM orders""")
def line_number(t: Tables):
    files = t.orders.select(F.col("o_orderpriority").alias("source"), "o_orderkey")
    keys, order = ["source"], ["o_orderkey"]
    return numbered(in_pieces(files, keys, order), keys, order, "line").select("source", "o_orderkey", "line")


@query("""
SELECT c_custkey AS id, (rich AND NOT builds) OR (NOT rich AND builds) AS exactly_one, rich OR builds AS any_of,
       CAST(rich AS INTEGER) + CAST(builds AS INTEGER) AS n_flags
FROM (SELECT c_custkey, c_acctbal > 5000 AS rich, c_mktsegment = 'BUILDING' AS builds FROM customer)""")
def bool_flags(t: Tables):
    rich, builds = F.col("c_acctbal") > 5000, F.col("c_mktsegment") == "BUILDING"
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        ((rich & ~builds) | (~rich & builds)).alias("exactly_one"),
        (rich | builds).alias("any_of"),
        (rich.cast("int") + builds.cast("int")).alias("n_flags"),
    )
