"""Stand-ins for the survey inputs, derived from the driver's tables.

Each function has the same table as a SQL ``WITH`` item next to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import month_index
from tallyframe.plans.registry import Tables, cents
from tallyframe.session import materialise

FIRST_YEAR = 1995

HOUSEHOLDS = """households AS (
  SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey AS nation,
         CAST(1 + c_custkey % 7 AS DOUBLE) AS wgt,
         c_mktsegment = 'BUILDING' AS claims, c_acctbal < 0 AS nochk,
         c_acctbal > 5000 AS any_card, c_nationkey < 12 AS one_card
  FROM customer)"""


def households(t: Tables) -> DataFrame:
    """Household cross-section with a survey weight."""
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
        (1 + F.col("c_custkey") % 7).cast("double").alias("wgt"),
        (F.col("c_mktsegment") == "BUILDING").alias("claims"),
        (F.col("c_acctbal") < 0).alias("nochk"),
        (F.col("c_acctbal") > 5000).alias("any_card"),
        (F.col("c_nationkey") < 12).alias("one_card"),
    )


MONTHS = """months AS (
  SELECT o_custkey AS id, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS period,
         round(sum(o_totalprice), 2) AS amount, count(*) AS n_orders,
         round(coalesce(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 0), 2) AS benefit,
         bool_or(o_orderstatus = 'F') AS sep, bool_or(o_orderpriority = '5-LOW') AS unemp
  FROM orders GROUP BY 1, 2)"""


def months(t: Tables) -> DataFrame:
    """Person-month panel: one row per customer and month with an order."""
    return (
        t.orders.withColumn("period", month_index(F.year("o_orderdate"), F.month("o_orderdate"), FIRST_YEAR))
        .groupBy(F.col("o_custkey").alias("id"), "period")
        .agg(
            cents(F.sum("o_totalprice")).alias("amount"),
            F.count(F.lit(1)).alias("n_orders"),
            cents(F.coalesce(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))), F.lit(0.0))).alias("benefit"),
            F.bool_or(F.col("o_orderstatus") == "F").alias("sep"),
            F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("unemp"),
        )
    )


PRICES = """prices AS (
  SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS month_cal,
         round(avg(o_totalprice), 4) AS price
  FROM orders GROUP BY 1)"""


def prices(t: Tables) -> DataFrame:
    """Monthly price index series."""
    return (
        t.orders.groupBy(month_index(F.year("o_orderdate"), F.month("o_orderdate"), FIRST_YEAR).alias("month_cal"))
        .agg(F.round(F.avg("o_totalprice"), 4).alias("price"))
    )


HISTORY = """history AS (
  SELECT user_id AS agent, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS period,
         CAST(least(count(*) FILTER (event_type = 'error'), 4) AS INTEGER) AS state,
         count(*) FILTER (event_type = 'click') / 10.0 AS effort,
         round(1 + sum(value) / 100, 6) AS cons
  FROM events GROUP BY 1, 2)"""


def history(t: Tables) -> DataFrame:
    """State history: one row per user and day seen; state 0 is a day without errors."""
    kind = F.col("event_type")
    return (
        t.events.groupBy(
            F.col("user_id").alias("agent"),
            F.date_diff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).alias("period"),
        )
        .agg(
            F.least(F.count_if(kind == "error"), F.lit(4)).cast("int").alias("state"),
            (F.count_if(kind == "click") / 10).alias("effort"),
            F.round(1 + F.sum("value") / 100, 6).alias("cons"),
        )
    )


TYPES = """days AS (
  SELECT event_type AS type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS period,
         round(avg(value), 6) AS cons, count(*) AS n, stddev_samp(value) / sqrt(count(*)) AS se_raw
  FROM events GROUP BY 1, 2),
start_share AS (
  SELECT event_type AS type, count(*)::DOUBLE / (SELECT count(*) FROM events) AS w_init FROM events GROUP BY 1),
types AS (
  SELECT d.type, d.period, d.cons, round(d.n::DOUBLE / (SELECT max(n) * 4 FROM days), 6) AS haz, s.w_init
  FROM days d JOIN start_share s USING (type))"""


def days(t: Tables) -> DataFrame:
    """Mean, count and standard error of the value by event type and day."""
    return t.events.groupBy(
        F.col("event_type").alias("type"),
        F.date_diff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).alias("period"),
    ).agg(
        F.round(F.avg("value"), 6).alias("cons"),
        F.count(F.lit(1)).alias("n"),
        (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("se_raw"),
    )


def types(t: Tables) -> DataFrame:
    """Types with a starting share, a consumption path and a hazard path in (0, 1)."""
    daily = materialise(days(t), "days")
    counted = daily.groupBy("type").agg(F.sum("n").alias("of_type"))
    start = counted.select("type", (F.col("of_type") / counted.agg(F.sum("of_type")).scalar()).alias("w_init"))
    most = daily.agg((F.max("n") * 4).alias("most"))
    return daily.join(start, "type").select(
        "type", "period", "cons", F.round(F.col("n") / most.scalar(), 6).alias("haz"), "w_init"
    )


TARGETS = """targets AS (
  SELECT type AS series, period, cons * 1.02 AS value, round(se_raw, 6) AS se FROM days WHERE n > 1)"""


def targets(t: Tables) -> DataFrame:
    """Target moments with standard errors."""
    return targets_of(days(t))


def targets_of(daily: DataFrame) -> DataFrame:
    return daily.filter("n > 1").select(
        F.col("type").alias("series"), "period", (F.col("cons") * 1.02).alias("value"), F.round("se_raw", 6).alias("se")
    )


DIARY = """diary AS (
  SELECT o_custkey AS person, dayofyear(o_orderdate) AS day, o_orderpriority AS pay_code,
         l_returnflag || l_linestatus AS merch_code, l_extendedprice AS amount,
         CAST(1 + o_custkey % 5 AS DOUBLE) AS ind_weight
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def diary(t: Tables) -> DataFrame:
    """Spending diary: person, day, payment, merchant kind, amount, weight."""
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("person"),
        F.dayofyear("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("pay_code"),
        F.concat("l_returnflag", "l_linestatus").alias("merch_code"),
        F.col("l_extendedprice").alias("amount"),
        (1 + F.col("o_custkey") % 5).cast("double").alias("ind_weight"),
    )


CATEGORY_SPEND = """category_spend AS (
  SELECT p_type AS category, round(sum(l_extendedprice * (1 - l_discount)) / 1000, 4) AS amount
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
benchmark_spend AS (
  SELECT p_type AS category, round(sum(p_retailprice * p_size), 4) AS amount FROM part GROUP BY 1)"""


def category_spend(t: Tables) -> DataFrame:
    """Spending by category (thousands)."""
    return (
        part_spend(t)
        .join(t.part, F.col("p_partkey") == F.col("l_partkey"))
        .groupBy(F.col("p_type").alias("category"))
        .agg(F.round(F.sum("net") / 1000, 4).alias("amount"))
    )


def part_spend(t: Tables) -> DataFrame:
    """Line items summed per part before any join, so a popular part is one row."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.groupBy("l_partkey").agg(
        F.sum(net).alias("net"), F.sum("l_extendedprice").alias("gross"), F.count(F.lit(1)).alias("n")
    )


def benchmark_spend(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("category")).agg(
        F.round(F.sum(F.col("p_retailprice") * F.col("p_size")), 4).alias("amount")
    )
