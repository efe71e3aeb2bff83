"""Panel building, event studies and cohort comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.numbers import wave_of
from tallyframe.operators import panel
from tallyframe.plans.inputs import HISTORY, MONTHS, PRICES, history, months, prices
from tallyframe.plans.registry import Tables, query, rounded
from tallyframe.session import materialise

INTERVIEWS = """interviews AS (
  SELECT o_custkey, c_nationkey, c_acctbal, c_mktsegment, m AS period,
         CAST(floor((m - 1) / 4) + 1 AS INTEGER) AS swave, CAST((m - 1) % 4 + 1 AS INTEGER) AS ref
  FROM (SELECT DISTINCT o_custkey, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS m FROM orders)
  JOIN customer ON c_custkey = o_custkey),
coded AS (SELECT *, CASE WHEN swave = 7 THEN '1' ELSE '' END || substr(c_mktsegment, 1, 2) AS entity,
  CASE WHEN swave = 7 THEN '1' ELSE '' END || o_custkey AS person,
  CASE WHEN c_acctbal > 2000 THEN o_custkey ELSE -1 END AS head, CAST(floor((c_acctbal + 1000) / 160) + 12 AS INTEGER) AS age FROM interviews)"""


def interviews(t: Tables):
    """Wave rows of survey persons: keys as text, one wave with longer codes."""
    month = F.month("o_orderdate")
    rows = t.orders.select("o_custkey", ((F.year("o_orderdate") - 1995) * 12 + month).alias("m")).distinct()
    wave = wave_of(F.col("m") - 1)
    longer = F.when(wave == 7, "1").otherwise("")
    return rows.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").cast("string").alias("unit"),
        F.concat(longer, F.substring("c_mktsegment", 1, 2)).alias("entity"),
        F.concat(longer, F.col("o_custkey").cast("string")).alias("person"),
        F.lit("a").alias("address"),
        F.substring("c_mktsegment", 1, 1).alias("family"),
        F.when(F.col("c_acctbal") > 2000, F.col("o_custkey")).otherwise(-1).alias("head"),
        (F.floor((F.col("c_acctbal") + 1000) / 160) + 12).cast("int").alias("age"),
        wave.alias("swave"),
        ((F.col("m") - 1) % 4 + 1).alias("ref"),
        (F.floor((F.col("m") - 1) / 12) + 1995).cast("int").alias("year"),
        ((F.col("m") - 1) % 12 + 1).alias("month"),
    )


@query(f"""
WITH {INTERVIEWS}, k AS (
  SELECT c_nationkey || substr(entity, CASE WHEN swave = 7 THEN 2 ELSE 1 END) || substr(person, CASE WHEN swave = 7 THEN 2 ELSE 1 END) AS id,
         c_nationkey || 'a' || substr(c_mktsegment, 1, 1) AS id_fam, (swave - 1) * 4 + ref AS period_index, period + 24 AS period_index_cal,
         CAST(person AS BIGINT) = head AS fam_head, age FROM coded),
h AS (SELECT *, max(CASE WHEN fam_head THEN age ELSE 0 END) OVER w AS hfam_age, count(*) OVER w AS n_members,
      count(*) FILTER (age >= 18) OVER w AS adults FROM k WINDOW w AS (PARTITION BY id_fam, period_index))
SELECT id, id_fam, period_index, period_index_cal, fam_head, hfam_age, n_members,
       CAST(CASE WHEN hfam_age < 70 THEN floor(hfam_age / 10) * 10 ELSE 70 END AS DOUBLE) AS hfam_age_bin, least(adults, 4) AS n_adults FROM h""")
def build_panel(t: Tables):
    built = panel.build_panel(
        materialise(interviews(t), "waves"),
        unit="unit",
        entity="entity",
        person="person",
        address="address",
        family="family",
        head="head",
        age="age",
        wave="swave",
        ref_month="ref",
        year="year",
        month="month",
        bad_wave=7,
        base_year=1993,
    )
    return built.select(
        "id", "id_fam", "period_index", "period_index_cal", "fam_head", "hfam_age", "n_members", "hfam_age_bin", "n_adults"
    )


@query(f"""
WITH {MONTHS}, {PRICES}, x AS (SELECT month_cal, (SELECT arg_max(price, month_cal) FROM prices) / price AS f FROM prices)
SELECT id, period, round(amount * f, 4) AS amount_adj, round(benefit * f, 4) AS benefit_adj FROM months LEFT JOIN x ON month_cal = period""")
def deflate(t: Tables):
    out = panel.deflate(months(t), prices(t), "period", "month_cal", "price", ["amount", "benefit"])
    return rounded(out.select("id", "period", "amount_adj", "benefit_adj"), 4, "amount_adj", "benefit_adj")


FLAGGED = f"""{MONTHS}, flagged AS (
  SELECT *, benefit > 0 AS ui_now, coalesce(lag(sep) OVER (PARTITION BY id ORDER BY period), false) AND unemp AS sep_to_unemp FROM months),
events_ AS (SELECT *, bool_or(ui_now) OVER w AS any_ui, bool_or(sep) OVER w AS any_sep, bool_or(sep_to_unemp) OVER w AS any_unemp
  FROM flagged WINDOW w AS (PARTITION BY id))"""


def flagged(t: Tables):
    return panel.flag_events(
        months(t),
        "id",
        "period",
        {"ui_now": F.col("benefit") > 0},
        {"sep_to_unemp": ("sep", F.col("unemp"))},
        {"any_ui": "ui_now", "any_sep": "sep", "any_unemp": "sep_to_unemp"},
    )


@query(f"WITH {FLAGGED} SELECT id, period, ui_now, sep_to_unemp, any_ui, any_sep, any_unemp FROM events_")
def flag_events(t: Tables):
    return flagged(t).select("id", "period", "ui_now", "sep_to_unemp", "any_ui", "any_sep", "any_unemp")


DATED = f"""{FLAGGED}, dated AS (
  SELECT *, min(CASE WHEN ui_now THEN period END) OVER w AS first_ui_date, max(CASE WHEN ui_now THEN period END) OVER w AS last_ui_date,
         min(CASE WHEN sep_to_unemp THEN period END) OVER w AS first_u_date FROM events_ WINDOW w AS (PARTITION BY id))"""


def dated(t: Tables):
    return panel.event_study(flagged(t), "id", "period", {"ui": "ui_now", "u": "sep_to_unemp"})


@query(f"""
WITH {DATED}
SELECT id, period, first_ui_date, last_ui_date, first_u_date, period - first_ui_date AS time_since_ui_start,
       period - last_ui_date AS time_since_ui_end, CAST(floor(first_ui_date / 4) + 1 AS INTEGER) AS first_ui_wave,
       CAST(4 * floor((period - first_ui_date) / 4) AS INTEGER) AS ui_t_wave FROM dated""")
def event_study(t: Tables):
    return dated(t).select(
        "id",
        "period",
        "first_ui_date",
        "last_ui_date",
        "first_u_date",
        "time_since_ui_start",
        "time_since_ui_end",
        "first_ui_wave",
        "ui_t_wave",
    )


@query(f"""
WITH {DATED}, p AS (
  SELECT id, period, amount,
         coalesce(period >= first_ui_date - 12 AND period < first_ui_date, false) AS inside FROM dated)
SELECT id, period, count(*) FILTER (inside) OVER w AS mos_in_horizon,
       CASE WHEN count(*) FILTER (inside AND amount IS NULL) OVER w = 0 THEN
         round(sum(CASE WHEN inside THEN amount END) OVER w / nullif(count(*) FILTER (inside) OVER w, 0), 4) END AS inc_prior
FROM p WINDOW w AS (PARTITION BY id)""")
def prior_window_mean(t: Tables):
    out = panel.prior_window_mean(dated(t), "id", "period", "first_ui_date", {"inc_prior": "amount"})
    return rounded(out.select("id", "period", "mos_in_horizon", "inc_prior"), 4, "inc_prior")


@query(f"""
WITH {MONTHS}, d AS (
  SELECT id, max(period) AS last_date, CAST(floor(16 + ('0x' || substr(md5(id || ':123'), 1, 8))::BIGINT / 4294967296.0 * (max(period) - 16)) AS INTEGER) AS drawn
  FROM months GROUP BY id),
v AS (SELECT d.id, drawn FROM d JOIN months m ON m.id = d.id AND m.period = drawn WHERE last_date >= 16 AND amount > 100000)
SELECT months.id, period, drawn AS pseudo_date FROM months LEFT JOIN v USING (id)""")
def pseudo_event(t: Tables):
    out = panel.pseudo_event(months(t), "id", "period", F.col("amount") > 100000, earliest=16, seed=123)
    return out.select("id", "period", "pseudo_date")


COHORTS = f"""{HISTORY}, drawn AS (
  SELECT agent, max(period) AS last_date, CAST(floor(12 + ('0x' || substr(md5(agent || ':7'), 1, 8))::BIGINT / 4294967296.0 * (max(period) - 12)) AS INTEGER) AS d
  FROM history GROUP BY agent),
placebo AS (SELECT h.agent, d FROM drawn JOIN history h ON h.agent = drawn.agent AND h.period = d WHERE last_date >= 12 AND h.state = 0),
starts AS (SELECT agent, 'Employed' AS key, d AS start_date FROM placebo
  UNION ALL SELECT agent, 'Unemployed: All', min(period) FROM history WHERE state >= 2 AND period >= 10 GROUP BY agent
  UNION ALL SELECT agent, 'Unemployed: Benefit', min(period) FROM history WHERE state >= 2 AND period >= 10 GROUP BY agent HAVING agent IN (SELECT agent FROM history WHERE state >= 3)),
copied AS (SELECT h.agent, h.period, h.state, h.effort, h.cons, key, start_date, period BETWEEN start_date - 10 AND start_date - 3 AS in_horizon FROM history h JOIN starts USING (agent)),
stack AS (SELECT *, CASE WHEN count(*) FILTER (in_horizon AND cons IS NULL) OVER w = 0 THEN sum(CASE WHEN in_horizon THEN cons END) OVER w / 8 END AS cons_prior,
         sum(CASE WHEN in_horizon THEN effort END) OVER w / 8 AS effort_prior
  FROM copied WINDOW w AS (PARTITION BY agent, key) QUALIFY count(*) FILTER (in_horizon) OVER w = 8)"""


def cohorts(t: Tables):
    rows = panel.pseudo_event(history(t), "agent", "period", F.col("state") == 0, earliest=12, seed=7)
    rows = panel.flag_events(
        rows,
        "agent",
        "period",
        {"hit": (F.col("state") >= 2) & (F.col("period") >= 10), "paid": F.col("state") >= 3},
        {},
        {"any_paid": "paid"},
    )
    rows = panel.event_study(rows, "agent", "period", {"u": "hit"})
    return panel.cohort_stack(
        rows,
        "agent",
        "period",
        {
            "Employed": ("pseudo_date", None),
            "Unemployed: All": ("first_u_date", None),
            "Unemployed: Benefit": ("first_u_date", F.col("any_paid")),
        },
        {"cons_prior": "cons", "effort_prior": "effort"},
        window=(10, 3),
        keep=["agent", "period", "state", "cons", "effort"],
    )


@query(f"""
WITH {COHORTS}
SELECT agent, period, key, start_date, in_horizon, round(cons_prior, 9) AS cons_prior, round(effort_prior, 9) AS effort_prior FROM stack""")
def cohort_stack(t: Tables):
    rows = cohorts(t).select("agent", "period", "key", "start_date", "in_horizon", "cons_prior", "effort_prior")
    return rounded(rows, 9, "cons_prior", "effort_prior")


@query(f"""
WITH {COHORTS}, at_start AS (SELECT *, CAST(1 + agent % 3 AS DOUBLE) AS wt FROM stack WHERE period = start_date),
m AS (SELECT key, sum(cons_prior * wt) / sum(wt) FILTER (cons_prior IS NOT NULL) AS cons, sum(effort_prior * wt) / sum(wt) AS effort,
      sum((cons > cons_prior)::INT * wt) / sum(wt) FILTER (cons > cons_prior IS NOT NULL) AS up FROM at_start GROUP BY 1),
q AS (SELECT key, min(cons_prior) FILTER (cum >= 0.5 * tot) AS median_cons FROM (
      SELECT key, cons_prior, sum(wt) OVER (PARTITION BY key ORDER BY cons_prior RANGE UNBOUNDED PRECEDING) AS cum, sum(wt) OVER (PARTITION BY key) AS tot FROM at_start WHERE cons_prior IS NOT NULL) GROUP BY 1),
a AS (SELECT key, median_cons, cons, effort, up FROM m LEFT JOIN q USING (key)
      UNION ALL SELECT 'Unemployed: Benefit, paid by transfer', NULL, cons * 0.86, effort, up FROM m WHERE key = 'Unemployed: Benefit')
SELECT key, round(median_cons, 9) AS median_cons, round(cons, 10) AS cons, round(effort, 10) AS effort, round(up, 10) AS up FROM a""")
def representativeness_table(t: Tables):
    rows = cohorts(t).withColumn("wt", (1 + F.col("agent") % 3).cast("double"))
    rows = rows.withColumn("cons_prior", F.round("cons_prior", 9))
    out = panel.representativeness_table(
        rows,
        "period",
        "wt",
        {"cons": F.col("cons_prior"), "effort": F.col("effort_prior"), "up": F.col("cons") > F.col("cons_prior")},
        ("median_cons", "cons_prior"),
        scaled=("Unemployed: Benefit", "Unemployed: Benefit, paid by transfer", 0.86, ["cons"]),
    )
    return rounded(rounded(out, 9, "median_cons"), 10, "cons", "effort", "up")
