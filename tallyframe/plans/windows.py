"""Window functions, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.functions.numbers import ratio
from tallyframe.operators import history as states
from tallyframe.operators import panel, reshape, series
from tallyframe.operators.attach import attach
from tallyframe.operators.ordered import in_pieces, lagged
from tallyframe.plans.inputs import HISTORY, MONTHS, TYPES, days, history, months, types
from tallyframe.plans.registry import Tables, query, rounded


@query("""
SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS top, bool_or(event_type = 'error') OVER w AS any_error
FROM events WINDOW w AS (PARTITION BY user_id)""")
def window_group_agg(t: Tables):
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    aggregates = [
        F.count(F.lit(1)).alias("n"),
        F.max("value").alias("top"),
        F.bool_or(F.col("event_type") == "error").alias("any_error"),
    ]
    return attach(rows, ["user_id"], aggregates, spread=["event_id"]).select("event_id", "n", "top", "any_error")


@query("""
SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events""")
def window_lag(t: Tables):
    keys, order = ["user_id"], ["ts", "event_id"]
    rows = in_pieces(t.events.select("event_id", "user_id", "ts", "event_type"), keys, order)
    return lagged(rows, keys, order, "event_type", "prior").select("event_id", "prior")


@query(f"""
WITH {TYPES}
SELECT type, period, round(cons / lag(cons) OVER (PARTITION BY type ORDER BY period) - 1, 6) AS growth FROM days""")
def pct_change(t: Tables):
    growth = series.pct_change(F.col("cons"), series.over_time(["type"], "period"))
    return rounded(days(t).select("type", "period", growth.alias("growth")), 6, "growth")


@query(f"""
WITH {TYPES}
SELECT type, period, round(product(1 - haz) OVER (PARTITION BY type ORDER BY period), 8) AS survival FROM types""")
def running_product(t: Tables):
    survival = series.running_product(1 - F.col("haz"), series.over_time(["type"], "period"))
    return rounded(types(t).select("type", "period", survival.alias("survival")), 8, "survival")


@query(f"""
WITH {TYPES}
SELECT type, period, round(n / sum(n) OVER (PARTITION BY period), 8) AS share FROM days""")
def share_of_period(t: Tables):
    share = ratio(F.col("n"), F.sum("n").over(Window.partitionBy("period")))
    return rounded(days(t).select("type", "period", share.alias("share")), 8, "share")


@query(f"""
WITH {TYPES}
SELECT type, period, round(cons / max(cons) FILTER (period = 10) OVER (PARTITION BY type), 6) AS to_day_10,
       round(cons / last_value(cons) OVER (PARTITION BY type ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS to_last
FROM days""")
def rebase_series(t: Tables):
    fixed = series.rebased(days(t), ["type"], "period", "cons", F.lit(10), "to_day_10")
    both = series.rebased(fixed, ["type"], "period", "cons", None, "to_last")
    return rounded(both.select("type", "period", "to_day_10", "to_last"), 6, "to_day_10", "to_last")


@query(f"""
WITH {TYPES}, levels AS (SELECT type, period, cons AS level FROM days)
SELECT type, period, round(level / max(level) FILTER (period = 10) OVER (PARTITION BY type), 6) AS chained FROM levels""")
def chain_index(t: Tables):
    growth = series.pct_change(F.col("cons"), series.over_time(["type"], "period"))
    grown = days(t).withColumn("growth", growth)
    chained = series.chain_index(grown, ["type"], "period", "growth", 10, "chained")
    return rounded(chained.select("type", "period", "chained"), 6, "chained")


@query(f"""
WITH {MONTHS}, dated AS (
  SELECT *, min(CASE WHEN benefit > 0 THEN period END) OVER (PARTITION BY id) AS first_date,
         max(CASE WHEN benefit > 0 THEN period END) OVER (PARTITION BY id) AS last_date FROM months)
SELECT id, period, first_date, last_date, period - first_date AS since_first, period - last_date AS since_last FROM dated""")
def event_time(t: Tables):
    flagged = months(t).withColumn("ui", F.col("benefit") > 0)
    dated = panel.event_study(flagged, "id", "period", {"ui": "ui"})
    return dated.select(
        "id",
        "period",
        F.col("first_ui_date").alias("first_date"),
        F.col("last_ui_date").alias("last_date"),
        F.col("time_since_ui_start").alias("since_first"),
        F.col("time_since_ui_end").alias("since_last"),
    )


@query(f"""
WITH {HISTORY}
SELECT agent, period, round(prior - cons, 6) AS onset_drop FROM (
  SELECT *, lag(cons) OVER w AS prior, lag(period) OVER w AS prior_period FROM history WINDOW w AS (PARTITION BY agent ORDER BY period))
WHERE state = 1 AND prior IS NOT NULL AND prior_period = period - 1""")
def onset_drop(t: Tables):
    drops = states.onset_drops(history(t), "agent", "period", "state", "cons")
    return rounded(drops.select("agent", "period", "onset_drop"), 6, "onset_drop")


@query(f"""
WITH {MONTHS} SELECT id, period, amount, row_number() OVER (PARTITION BY id ORDER BY period) AS seq FROM months""")
def sort_multi(t: Tables):
    seq = F.row_number().over(Window.partitionBy("id").orderBy("period"))
    return months(t).select("id", "period", "amount", seq.cast("long").alias("seq")).orderBy("id", "period")


SIZES = ["SMALL", "MEDIUM", "LARGE", "STANDARD", "ECONOMY", "PROMO"]


@query("""
SELECT p_type, count(*) AS n, CAST(list_position(['SMALL', 'MEDIUM', 'LARGE', 'STANDARD', 'ECONOMY', 'PROMO'], p_type) AS INTEGER) AS sort_key
FROM part GROUP BY 1""")
def sort_levels(t: Tables):
    counts = t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return reshape.sorted_by_level(counts, "p_type", SIZES)


@query("""
SELECT c_custkey AS key, c_acctbal AS balance, 'customer' AS kind FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier""")
def union_by_name(t: Tables):
    customers = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    suppliers = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return reshape.stacked(customers, suppliers)


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_values(t: Tables):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()
