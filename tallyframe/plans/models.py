"""Series, run collation, state histories and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.numbers import ratio
from tallyframe.operators import history as states
from tallyframe.operators import inference, runs, series
from tallyframe.plans.inputs import HISTORY, TARGETS, TYPES, days, history, targets_of, types
from tallyframe.plans.registry import Tables, query, rounded
from tallyframe.plans.scans import CONFIGS, configs
from tallyframe.session import materialise, new_path
from tallyframe.sources import readers, writers


@query(f"""
WITH {TYPES}, raw AS (
  SELECT type AS series, period, cons AS value, CASE WHEN type <> 'error' THEN se_raw END AS se, cons - 1.96 * se_raw AS low, cons + 1.96 * se_raw AS high
  FROM days WHERE type <> 'view' OR period >= 5),
r AS (SELECT series, round_even(value, 3) AS value,
             round_even(coalesce(se, (high - low) / 3.92), CASE WHEN series = 'view' THEN 6 WHEN series = 'click' THEN 5 ELSE 3 END) AS se,
      row_number() OVER (PARTITION BY series ORDER BY period) AS n, count(*) OVER (PARTITION BY series) AS len FROM raw),
l AS (SELECT max(len) AS longest FROM r),
p AS (SELECT series, CAST(n + longest - len AS INTEGER) AS position, value,
      CASE WHEN n = 1 AND series = 'view' THEN coalesce(lead(se) OVER (PARTITION BY series ORDER BY n), se) ELSE se END AS se FROM r, l)
SELECT * FROM p UNION ALL
SELECT series, CAST(unnest(range(1, longest - len + 1)) AS INTEGER), NULL, NULL FROM (SELECT DISTINCT series, len FROM r), l WHERE longest > len""")
def target_moments(t: Tables):
    raw = days(t).filter("type <> 'view' OR period >= 5").select(
        F.col("type").alias("series"),
        "period",
        F.col("cons").alias("value"),
        F.when(F.col("type") != "error", F.col("se_raw")).alias("se"),
        (F.col("cons") - 1.96 * F.col("se_raw")).alias("low"),
        (F.col("cons") + 1.96 * F.col("se_raw")).alias("high"),
    )
    longest = raw.groupBy("series").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
    digits = {"view": 6, "click": 5, **{s: 3 for s in ("error", "login", "logout", "purchase", "signup")}}
    return series.target_moments(raw, longest, se_digits=digits, repair=["view"])


MIXTURE = """base AS (
  SELECT o_orderpriority AS opt_type, CAST(c_nationkey AS BIGINT) AS run, min(o_totalprice) AS k0, max(o_totalprice) AS k1,
         avg((o_orderstatus = 'F')::INT) AS w_lo_k, min(c_acctbal) AS b0, max(c_acctbal) AS b1, avg((o_orderstatus = 'O')::INT) AS w_lo_b
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


@query(f"""
WITH {MIXTURE}
SELECT opt_type, run, type, k, b, round(wk * wb, 6) AS weight FROM (
  SELECT opt_type, run, unnest([0, 1, 2, 3]) AS type, unnest([k0, k0, k1, k1]) AS k, unnest([b0, b1, b0, b1]) AS b,
         unnest([w_lo_k, w_lo_k, 1 - w_lo_k, 1 - w_lo_k]) AS wk, unnest([w_lo_b, 1 - w_lo_b, w_lo_b, 1 - w_lo_b]) AS wb FROM base)""")
def type_mixture(t: Tables):
    rows = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(F.col("o_orderpriority").alias("opt_type"), F.col("c_nationkey").cast("long").alias("run"))
        .agg(
            F.min("o_totalprice").alias("k0"),
            F.max("o_totalprice").alias("k1"),
            F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("w_lo_k"),
            F.min("c_acctbal").alias("b0"),
            F.max("c_acctbal").alias("b1"),
            F.avg((F.col("o_orderstatus") == "O").cast("int")).alias("w_lo_b"),
        )
    )
    mixed = series.type_mixture(
        rows,
        ["opt_type", "run"],
        {"k": (F.col("k0"), F.col("k1"), F.col("w_lo_k")), "b": (F.col("b0"), F.col("b1"), F.col("w_lo_b"))},
    )
    return rounded(mixed, 6, "weight")


@query(f"""
WITH {CONFIGS}
SELECT opt_type, run, fit, k0, row_number() OVER (PARTITION BY opt_type ORDER BY fit, run) AS rank FROM configs""")
def collate_runs(t: Tables):
    folder = new_path(t.spark, "results")
    writers.write_json(configs(t), f"{folder}/sim_all")
    documents = readers.read_result_documents(t.spark, folder, "sim_", "opt_type string, run long, fit double, k0 double")
    return runs.collate_runs(documents, "opt_type", "fit", "run")


EVOLVED = f"""{TYPES}, lagged AS (
  SELECT *, coalesce(lag(haz) OVER w, 0) AS haz_prior, cons / lag(cons) OVER w - 1 AS growth FROM types WINDOW w AS (PARTITION BY type ORDER BY period)),
left_ AS (SELECT *, w_init * product(1 - haz_prior) OVER (PARTITION BY type ORDER BY period) AS remaining FROM lagged),
detail AS (SELECT *, remaining / sum(remaining) OVER (PARTITION BY period) AS share FROM left_),
mixed AS (SELECT period, coalesce(sum(growth * share), 0) AS g, sum(haz * share) AS hazard FROM detail GROUP BY 1),
level AS (SELECT *, product(1 + g) OVER (ORDER BY period) AS lv FROM mixed)"""


@query(f"""
WITH {EVOLVED}
SELECT period, round(lv / (SELECT lv FROM level WHERE period = 10), 6) AS cons_index, round(hazard, 6) AS hazard FROM level""")
def composition_series(t: Tables):
    whole = types(t).withColumn("model", F.lit("base"))
    out = series.composition_series(whole, ["model"], "type", "period", "cons", "haz", "w_init", base=10)
    return rounded(out.drop("model"), 6, "cons_index", "hazard")


@query(f"""
WITH {EVOLVED}
SELECT type, period, cons, haz, round(remaining, 8) AS remaining, round(share, 8) AS share,
       round(sum(CASE WHEN type IN ('click', 'view') THEN share ELSE 0 END) OVER (PARTITION BY period), 8) AS share_of_pair FROM detail""")
def type_paths(t: Tables):
    detail = series.type_shares(types(t), [], "type", "period", "cons", "haz", "w_init")
    pair = series.share_of_types(detail, [], "type", "period", ["click", "view"], "share_of_pair")
    out = detail.join(pair, "period").select("type", "period", "cons", "haz", "remaining", "share", "share_of_pair")
    return rounded(out, 8, "remaining", "share", "share_of_pair")


MODELS = f"""{TYPES}, {TARGETS}, models AS (
  SELECT 'base' AS name, type AS series, period, cons AS value FROM days
  UNION ALL SELECT 'scaled', type, period, cons * 1.02 + 1 FROM days),
gaps AS (
  SELECT name, series, pow((m.value - t.value) / nullif(se, 0), 2) AS d
  FROM models m FULL JOIN (SELECT n.name, targets.* FROM targets, (SELECT DISTINCT name FROM models) n) t USING (name, series, period)),
fits AS (
  SELECT name, series, CASE WHEN count(*) FILTER (d IS NULL) = 0 THEN sum(d) END AS distance, count(*) FILTER (d IS NULL) AS undefined
  FROM gaps GROUP BY GROUPING SETS ((name, series), (name)))"""


def written_days(t: Tables):
    """Daily moments as a written table, for queries that read them more than once."""
    return materialise(days(t), "days")


def fitted(daily):
    factor = F.array(
        F.struct(F.lit("base").alias("name"), F.col("cons").alias("value")),
        F.struct(F.lit("scaled").alias("name"), (F.col("cons") * 1.02 + 1).alias("value")),
    )
    return daily.select(F.col("type").alias("series"), "period", F.inline(factor))


@query(f"""
WITH {MODELS}
SELECT name, series, round(distance, 3) AS distance, undefined FROM fits""")
def fit_distance(t: Tables):
    daily = written_days(t)
    out = series.fit_distance(fitted(daily), targets_of(daily), ["name"], "series", "period", "value", "se")
    return rounded(out, 3, "distance")


@query(f"""
WITH {MODELS}, fit AS (SELECT * FROM fits WHERE series IS NOT NULL)
SELECT series, period, value, value - 1.96 * se AS lower, value + 1.96 * se AS upper, 'Data' AS label FROM targets
UNION ALL SELECT series, period, value, value, value, coalesce(name || ', GOF=' || CAST(floor(distance) AS BIGINT), name)
FROM models LEFT JOIN fit USING (name, series)""")
def series_long(t: Tables):
    daily = written_days(t)
    models, moments = fitted(daily), targets_of(daily)
    fit = series.fit_distance(models, moments, ["name"], "series", "period", "value", "se").dropna(subset=["series"])
    return series.series_long(moments, models, fit)


@query(f"""
WITH {HISTORY}, f AS (SELECT avg((state = 0)::INT) AS e, avg(effort) AS s, avg(cons) AS c FROM history)
SELECT 'share_' || state AS statistic, round(count(*) / (SELECT count(*) FROM history), 8) AS value FROM history GROUP BY state
UNION ALL SELECT 'employment_rate', round(e, 8) FROM f UNION ALL SELECT 'avg_effort', round(s / (1 - e), 8) FROM f
UNION ALL SELECT 'avg_cons', round(c, 8) FROM f""")
def state_occupancy(t: Tables):
    rows = written_history(t)
    shares = states.state_counts(rows, [], "state").select(
        F.concat(F.lit("share_"), F.col("state").cast("string")).alias("statistic"), F.col("share").alias("value")
    )
    rates = states.state_occupancy(rows, [], "state", "effort", means=["cons"])
    return rounded(shares.unionByName(rates.unpivot([], rates.columns, "statistic", "value")), 8, "value")


SCHEDULE = f"""{HISTORY}, occupancy AS (
  SELECT week, state, n / sum(n) OVER (PARTITION BY week) AS share FROM (
    SELECT CAST(floor(period / 7) AS BIGINT) AS week, state, count(*) AS n FROM history GROUP BY 1, 2)),
schedule AS (SELECT state, round(1 - 0.1 * state + avg(cons) / 1000, 6) AS pay FROM history GROUP BY 1)"""


def written_history(t: Tables):
    """The panel as a written table, for queries that read it more than once."""
    return materialise(history(t), "history")


def weekly(rows):
    return rows.withColumn("week", F.floor(F.col("period") / 7))


def schedule(rows):
    """Pay by state: a benefit that falls with the state."""
    return rows.groupBy("state").agg(F.round(1 - 0.1 * F.col("state") + F.avg("cons") / 1000, 6).alias("pay"))


@query(f"""
WITH {SCHEDULE}
SELECT week, round(coalesce(sum(share * (pay - 0.2)) FILTER (state > 0), 0), 6) AS cost,
       round(coalesce(sum(share * (1 - pay)) FILTER (state = 0), 0), 6) AS revenue, round(sum(share), 6) AS occupied
FROM occupancy JOIN schedule USING (state) GROUP BY 1""")
def programme_budget(t: Tables):
    rows = written_history(t)
    occupancy = states.state_counts(weekly(rows), ["week"], "state")
    out = states.programme_budget(occupancy, schedule(rows), ["week"], "state", "pay", base_income=0.2)
    return rounded(out, 6, "cost", "revenue", "occupied")


def npv_sql(flow: str) -> str:
    return f"sum({flow} * pow(1.01, -period))"


FLOWS = {
    "u_cons": "(pow(cons, -1.0) / -1.0)",
    "u_cons_ue": "(pow(CASE WHEN state > 0 THEN cons ELSE 0.0001 END, -1.0) / -1.0)",
    "u_cons_emp": "(pow(CASE WHEN state = 0 THEN cons ELSE 0.0001 END, -1.0) / -1.0)",
    "u_search": "(-3.0 * pow(CASE WHEN state > 0 THEN effort ELSE 0 END, 2.5) / 2.5)",
}
UTILITY = {"rate": 0.01, "rho": 2.0, "k": 3.0, "phi": 1.5}


@query(f"""
WITH {HISTORY}
SELECT agent, {", ".join(f"round({npv_sql(f)}, 5) AS {n}" for n, f in FLOWS.items())},
       round({npv_sql(FLOWS["u_cons"])} + {npv_sql(FLOWS["u_search"])}, 5) AS u_tot FROM history GROUP BY 1""")
def npv_by_entity(t: Tables):
    out = states.npv_by_entity(history(t), ["agent"], "period", "state", "cons", "effort", **UTILITY)
    return rounded(out, 5, *[c for c in out.columns if c != "agent"])


@query(f"""
WITH {HISTORY}, worlds AS (
  SELECT unnest(['base', 'modified', 'numeraire']) AS scenario, unnest([cons, CASE WHEN state = 0 THEN cons * 0.99 ELSE cons * 1.05 END, cons * 1.01]) AS c,
         agent % 2 AS type, state, effort, period FROM history),
u AS (SELECT scenario, type, sum(pow(c, -1.0) / -1.0 * pow(1.01, -period)) AS u_cons,
      sum(-3.0 * pow(CASE WHEN state > 0 THEN effort ELSE 0 END, 2.5) / 2.5 * pow(1.01, -period) * CASE WHEN scenario = 'modified' THEN 0.98 ELSE 1 END) AS u_search,
      sum(CASE WHEN state > 0 THEN c END) / count(*) AS ui_ex, sum(CASE WHEN state = 0 THEN c END) / count(*) AS tax_rev FROM worlds GROUP BY 1, 2),
w AS (SELECT agent % 2 AS type, count(DISTINCT agent)::DOUBLE / (SELECT count(DISTINCT agent) FROM history) AS w FROM history GROUP BY 1),
x AS (SELECT type, w, m.u_cons - b.u_cons AS smooth, m.u_search - b.u_search AS search, n.u_cons + n.u_search - b.u_cons - b.u_search AS unit,
      m.ui_ex AS mod_ui_ex, m.tax_rev AS mod_tax_rev, b.ui_ex AS base_ui_ex, b.tax_rev AS base_tax_rev
      FROM (SELECT * FROM u WHERE scenario = 'modified') m JOIN (SELECT * FROM u WHERE scenario = 'base') b USING (type)
      JOIN (SELECT * FROM u WHERE scenario = 'numeraire') n USING (type) JOIN w USING (type)),
y AS (SELECT 'type_' || type AS unit_of, 1.0 AS w, smooth, search, unit, mod_ui_ex, mod_tax_rev, base_ui_ex, base_tax_rev FROM x
      UNION ALL SELECT 'combined', w, smooth, search, unit, mod_ui_ex, mod_tax_rev, base_ui_ex, base_tax_rev FROM x)
SELECT unit_of, round(sum(w * smooth) / sum(w * unit), 5) AS "dW_smooth", round(sum(w * search) / sum(w * unit), 5) AS "dW_search",
       round(sum(w * (smooth + search)) / sum(w * unit), 5) AS "dW_tot", round(sum(w * mod_ui_ex), 5) AS mod_ui_ex, round(sum(w * mod_tax_rev), 5) AS mod_tax_rev,
       round(sum(w * base_ui_ex), 5) AS base_ui_ex, round(sum(w * base_tax_rev), 5) AS base_tax_rev FROM y GROUP BY 1""")
def welfare_decomposition(t: Tables):
    cons = F.col("cons")
    working = F.col("state") == 0
    worlds = F.array(
        F.struct(F.lit("base").alias("scenario"), cons.alias("c"), F.lit(1.0).alias("pain")),
        F.struct(
            F.lit("modified").alias("scenario"), F.when(working, cons * 0.99).otherwise(cons * 1.05).alias("c"), F.lit(0.98).alias("pain")
        ),
        F.struct(F.lit("numeraire").alias("scenario"), (cons * 1.01).alias("c"), F.lit(1.0).alias("pain")),
    )
    panel = written_history(t)
    rows = panel.select((F.col("agent") % 2).alias("type"), "agent", "period", "state", "effort", F.inline(worlds))
    value = states.npv_by_entity(rows, ["scenario", "pain", "type"], "period", "state", "c", "effort", **UTILITY)
    value = value.withColumn("u_search", F.col("u_search") * F.col("pain")).withColumn("u_tot", F.col("u_cons") + F.col("u_search"))
    budget = rows.groupBy("scenario", "type").agg(
        (F.sum(F.when(~working, F.col("c"))) / F.count(F.lit(1))).alias("ui_ex"),
        (F.sum(F.when(working, F.col("c"))) / F.count(F.lit(1))).alias("tax_rev"),
    )
    people = panel.groupBy((F.col("agent") % 2).alias("type")).agg(F.count_distinct("agent").alias("n"))
    weight = people.select("type", (F.col("n") / people.agg(F.sum("n")).scalar()).alias("w"))
    table = value.join(budget, ["scenario", "type"]).join(weight, "type")
    out = states.welfare_decomposition(table, "type", "w", "scenario", "modified", "base", "numeraire")
    return rounded(out, 5, *[c for c in out.columns if c != "unit_of"])


@query(f"""
WITH {SCHEDULE}, m AS (SELECT state, avg(cons) AS c, count(*) / (SELECT count(*) FROM history) AS share FROM history GROUP BY 1),
s AS (SELECT state, share, c / (SELECT c FROM m WHERE state = 0) AS c, pay AS base, pay + CASE state WHEN 0 THEN -0.01 ELSE 0.05 END AS mod FROM m JOIN schedule USING (state)),
x AS (SELECT sum((mod - base) * pow(c, -2.0) * share) FILTER (state = 0) AS tax, sum(pow(c, -2.0) * share) FILTER (state BETWEEN 1 AND 3) AS mu_time,
      sum(share) FILTER (state BETWEEN 1 AND 3) AS covered, max(mod - base) FILTER (state = 1) AS up,
      sum(share * pow(c, -2.0) * (mod - base)) FILTER (state = 4) AS ext, max(c) FILTER (state = 0) AS c0 FROM s),
r AS (SELECT unnest(['increase', 'fixed_drop', 'extension']) AS reading, unnest([tax + mu_time * up, tax + covered * pow((1 - 0.068) * c0, -2.0) * up, tax + ext]) AS net FROM x)
SELECT reading, round(net, 6) AS net, round(net / (pow(1.01, -1.0) / -1.0 + 1), 5) AS normalised FROM r""")
def sufficient_stat_gain(t: Tables):
    rows = written_history(t)
    shares = states.state_counts(rows, [], "state").drop("n")
    means = rows.groupBy("state").agg(F.avg("cons").alias("c"))
    base = rows.filter("state = 0").agg(F.avg("cons"))
    change = F.when(F.col("state") == 0, -0.01).otherwise(0.05)
    table = (
        shares.join(means, "state")
        .join(schedule(rows), "state")
        .select("state", "share", (F.col("c") / base.scalar()).alias("c"), F.col("pay").alias("base"), (F.col("pay") + change).alias("mod"))
    )
    out = states.sufficient_stat_gain(
        table,
        by=[],
        state="state",
        share="share",
        cons="c",
        pay_base="base",
        pay_mod="mod",
        rho=2.0,
        last_covered=3,
        cons_drop=0.068,
    )
    return rounded(rounded(out, 6, "net"), 5, "normalised")


@query(f"""
WITH {SCHEDULE}, r AS (
  SELECT week, sum(share) FILTER (state = 0) AS e, sum(share) FILTER (state BETWEEN 1 AND 2) AS cov, sum(share) FILTER (state = 3) AS nxt,
         max(pay) FILTER (state = 0) AS z0, max(pay) FILTER (state = 1) AS z1, max(pay) FILTER (state = 2) AS zl, max(pay) FILTER (state = 3) AS zn
  FROM occupancy JOIN schedule USING (state) GROUP BY 1),
x AS (SELECT *, nxt * (zl - zn) AS mc, nxt * (zl - zn) * 1.3 / e AS tax FROM r), y AS (SELECT *, tax * e / 1.2 / cov AS db FROM x)
SELECT week, round(mc, 6) AS mechanical_cost, round(tax, 6) AS tax, round(db, 6) AS benefit_change,
       round((z0 + tax) / z0 - 1, 6) AS tax_rate, round(db / z1, 6) AS benefit_rate FROM y""")
def budget_neutral_change(t: Tables):
    rows = written_history(t)
    occupancy = states.state_counts(weekly(rows), ["week"], "state")
    out = states.budget_neutral_change(
        occupancy, schedule(rows), ["week"], "state", "pay", last_covered=2, cost_extension=1.3, cost_increase=1.2
    )
    return rounded(out, 6, *[c for c in out.columns if c != "week"])


@query(f"""
WITH {HISTORY}, drops AS (SELECT prior - cons AS d FROM (
  SELECT *, lag(cons) OVER w AS prior, lag(period) OVER w AS prior_period FROM history WINDOW w AS (PARTITION BY agent ORDER BY period))
  WHERE state = 1 AND prior IS NOT NULL AND prior_period = period - 1)
SELECT 'cbar_' || state AS statistic, round(avg(cons), 6) AS value FROM history GROUP BY state
UNION ALL SELECT 'onset_drop_25th', round(quantile_cont(d, 0.25), 6) FROM drops
UNION ALL SELECT 'onset_drop_50th', round(quantile_cont(d, 0.5), 6) FROM drops
UNION ALL SELECT 'onset_drop_75th', round(quantile_cont(d, 0.75), 6) FROM drops
UNION ALL SELECT 'onset_drop_mean', round(avg(d), 6) FROM drops""")
def onset_profile(t: Tables):
    return rounded(states.onset_profile(written_history(t), "agent", "period", "state", "cons"), 6, "value")


PARAMETERS = ["rho", "phi"]
PERTURBED = f"""{TYPES}, {TARGETS}, runs AS (
  SELECT type, period, unnest(['rho', 'rho', 'phi', 'phi']) AS parameter, unnest(['minus', 'plus', 'minus', 'plus']) AS side,
         unnest([pow(cons, 0.999), pow(cons, 1.001), cons * 0.999 * 0.999, cons * 1.001 * 1.001]) AS value FROM days),
gradient AS (SELECT type, period, parameter, (max(value) FILTER (side = 'plus') - max(value) FILTER (side = 'minus')) / 0.002 AS partial FROM runs GROUP BY 1, 2, 3)"""


def gradients(daily):
    cons = F.col("cons")

    def run(parameter, side, value):
        return F.struct(F.lit(parameter).alias("parameter"), F.lit(side).alias("side"), value.alias("value"))

    cells = F.array(
        run("rho", "minus", F.pow(cons, F.lit(0.999))),
        run("rho", "plus", F.pow(cons, F.lit(1.001))),
        run("phi", "minus", cons * 0.999 * 0.999),
        run("phi", "plus", cons * 1.001 * 1.001),
    )
    perturbed = daily.select(F.concat_ws("/", "type", "period").alias("moment"), F.inline(cells))
    return inference.central_difference(perturbed, ["moment", "parameter"], "side", "value", 0.001)


@query(f"WITH {PERTURBED} SELECT type || '/' || period AS moment, parameter, round(partial, 4) AS partial FROM gradient")
def central_difference(t: Tables):
    return rounded(gradients(days(t)), 4, "partial")


@query(f"""
WITH {PERTURBED}, w AS (SELECT series AS type, period, 1 / (value * value) AS w FROM targets)
SELECT a.parameter AS param_i, b.parameter AS param_j, round(sum(w * a.partial * b.partial), 3) AS value
FROM gradient a JOIN gradient b USING (type, period) JOIN w USING (type, period) GROUP BY 1, 2""")
def weighted_gram(t: Tables):
    daily = written_days(t)
    weight = targets_of(daily).select(F.concat_ws("/", "series", "period").alias("moment"), ratio(F.lit(1), F.col("value") * F.col("value")).alias("w"))
    out = inference.weighted_gram(gradients(daily), "moment", "parameter", PARAMETERS, weight, "w")
    return rounded(out, 3, "value")
