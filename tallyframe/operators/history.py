"""Statistics over long state histories: one row per (agent, period).

State 0 is employed, state 1 the first period of unemployment, higher states the
later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numbers import effort_cost, isoelastic, marginal_isoelastic, ratio
from tallyframe.operators.weights import weighted_quantiles
from tallyframe.session import materialise

CONSUMPTION_FLOOR = 0.0001
NUMERAIRE_STEP = 0.01


def state_counts(history: DataFrame, by: list[str], state: str) -> DataFrame:
    """(by..., state, share of agent-periods); the total is taken on the counts."""
    counts = history.groupBy(*by, state).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, F.lit(0)))
    return counts.select(*by, state, "n", ratio(F.col("n"), total).alias("share"))


def state_occupancy(
    history: DataFrame, by: list[str], state: str, effort: str, means: list[str] | None = None
) -> DataFrame:
    """Employment rate, mean effort per unemployed period, and plain means (assets, say) as avg_{name}."""
    employed = F.avg((F.col(state) == 0).cast("double"))
    return history.groupBy(*by).agg(
        employed.alias("employment_rate"),
        ratio(F.avg(effort), 1 - employed).alias("avg_effort"),
        *[F.avg(m).alias(f"avg_{m}") for m in means or []],
    )


def programme_budget(
    occupancy: DataFrame, schedule: DataFrame, by: list[str], state: str, pay: str, base_income: float
) -> DataFrame:
    """Benefit cost and tax revenue from time in each state and its pay.

    ``occupied`` should be 1: the states of the schedule cover the history.
    """
    priced = occupancy.join(schedule.select(state, pay), state)
    share, z = F.col("share"), F.col(pay)
    return priced.groupBy(*by).agg(
        F.sum(F.when(F.col(state) > 0, share * (z - base_income)).otherwise(0.0)).alias("cost"),
        F.sum(F.when(F.col(state) == 0, share * (1 - z)).otherwise(0.0)).alias("revenue"),
        F.sum("share").alias("occupied"),
    )


def npv_by_entity(
    history: DataFrame,
    by: list[str],
    period: str,
    state: str,
    cons: str,
    effort: str,
    *,
    rate: float,
    rho: float,
    k: float,
    phi: float,
    start: int = 0,
) -> DataFrame:
    """Discounted utility of consumption and cost of effort per entity.

    The split into unemployed and employed utility masks the other periods with a
    small consumption, as power utility has no value at zero.
    """
    factor = F.pow(F.lit(1.0 + rate), (F.lit(start) - F.col(period)).cast("double"))
    working = F.col(state) == 0

    def masked(mask: Column) -> Column:
        kept = F.when(mask, F.col(cons)).otherwise(0.0)
        return F.when(kept == 0, F.lit(CONSUMPTION_FLOOR)).otherwise(kept)

    flows = {
        "u_cons": isoelastic(F.col(cons), rho),
        "u_cons_ue": isoelastic(masked(~working), rho),
        "u_cons_emp": isoelastic(masked(working), rho),
        "u_search": -effort_cost(F.when(~working, F.col(effort)).otherwise(0.0), k, phi),
    }
    sums = history.groupBy(*by).agg(*[F.sum(flow * factor).alias(n) for n, flow in flows.items()])
    return sums.withColumn("u_tot", F.col("u_cons") + F.col("u_search"))


def welfare_decomposition(
    df: DataFrame, type_: str, weight: str, scenario: str, modified: str, baseline: str, numeraire: str
) -> DataFrame:
    """Welfare change per unit of numeraire, by type and combined.

    ``df`` has one row per (scenario, type) with u_cons, u_search, u_tot, ui_ex,
    tax_rev and the type's weight.  Combined changes are ratios of weighted sums;
    combined budgets are weighted sums.
    """

    def at(name: str, which: str) -> Column:
        return F.max(F.when(F.col(scenario) == which, F.col(name)))

    by_type = df.groupBy(type_).agg(
        F.max(weight).alias("w"),
        (at("u_cons", modified) - at("u_cons", baseline)).alias("smooth"),
        (at("u_search", modified) - at("u_search", baseline)).alias("search"),
        (at("u_tot", numeraire) - at("u_tot", baseline)).alias("unit"),
        *[
            at(n, s).alias(f"{p}_{n}")
            for p, s in (("mod", modified), ("base", baseline))
            for n in ("ui_ex", "tax_rev")
        ],
    )
    budgets = ["mod_ui_ex", "mod_tax_rev", "base_ui_ex", "base_tax_rev"]
    own = F.struct(F.concat(F.lit("type_"), F.col(type_).cast("string")).alias("unit_of"), F.lit(1.0).alias("v"))
    all_ = F.struct(F.lit("combined").alias("unit_of"), F.col("w").alias("v"))
    weighted = by_type.select("*", F.inline(F.array(own, all_)))
    sums = weighted.groupBy("unit_of").agg(
        *[F.sum(F.col(c) * F.col("v")).alias(c) for c in ("smooth", "search", "unit", *budgets)]
    )
    return sums.select(
        "unit_of",
        ratio(F.col("smooth"), F.col("unit")).alias("dW_smooth"),
        ratio(F.col("search"), F.col("unit")).alias("dW_search"),
        ratio(F.col("smooth") + F.col("search"), F.col("unit")).alias("dW_tot"),
        *budgets,
    )


def sufficient_stat_gain(
    states: DataFrame,
    *,
    by: list[str],
    state: str,
    share: str,
    cons: str,
    pay_base: str,
    pay_mod: str,
    rho: float,
    last_covered: int,
    cons_drop: float,
) -> DataFrame:
    """Welfare gain of benefit changes from shares and marginal utilities.

    ``states`` has one row per state with its share of time, consumption relative
    to employment, and pay before and after.  Three readings: ``increase`` uses the
    marginal utility seen in the covered states, ``fixed_drop`` the one implied by
    a given drop at onset, ``extension`` that of the first state past coverage.
    Each is the tax loss plus the benefit gain over a numeraire step.
    """
    s, t = F.col(state), F.col(share)
    mu = marginal_isoelastic(F.col(cons), rho)
    change = F.col(pay_mod) - F.col(pay_base)
    covered = (s >= 1) & (s <= last_covered)
    sums = states.groupBy(*by).agg(
        F.sum(F.when(s == 0, change * mu * t)).alias("tax"),
        F.sum(F.when(covered, mu * t)).alias("mu_time"),
        F.sum(F.when(covered, t)).alias("time"),
        F.max(F.when(s == 1, change)).alias("raise_"),
        F.max(F.when(s == 0, F.col(cons))).alias("cons_emp"),
        F.sum(F.when(s == last_covered + 1, t * mu * change)).alias("extension"),
    )
    step = isoelastic(F.lit(1 + NUMERAIRE_STEP), rho) - isoelastic(F.lit(1.0), rho)
    dropped = marginal_isoelastic((1 - cons_drop) * F.col("cons_emp"), rho)
    gains = {
        "increase": F.col("mu_time") * F.col("raise_"),
        "fixed_drop": F.col("time") * dropped * F.col("raise_"),
        "extension": F.col("extension"),
    }
    rows = F.array(
        *[F.struct(F.lit(n).alias("reading"), (F.col("tax") + g).alias("net")) for n, g in gains.items()]
    )
    return sums.select(*by, F.inline(rows)).withColumn("normalised", F.col("net") / step)


def budget_neutral_change(
    occupancy: DataFrame,
    schedule: DataFrame,
    by: list[str],
    state: str,
    pay: str,
    last_covered: int,
    cost_extension: float = 1.0,
    cost_increase: float = 1.0,
) -> DataFrame:
    """The tax that pays for a longer benefit, and the raise the same tax buys.

    The cost multipliers are total over mechanical cost of each change.
    """
    s, t = F.col(state), F.col("share")
    row = (
        occupancy.join(schedule.select(state, pay), state)
        .groupBy(*by)
        .agg(
            F.sum(F.when(s == 0, t)).alias("employed"),
            F.sum(F.when((s >= 1) & (s <= last_covered), t)).alias("covered"),
            F.sum(F.when(s == last_covered + 1, t)).alias("next"),
            F.max(F.when(s == 0, F.col(pay))).alias("z0"),
            F.max(F.when(s == 1, F.col(pay))).alias("z1"),
            F.max(F.when(s == last_covered, F.col(pay))).alias("z_last"),
            F.max(F.when(s == last_covered + 1, F.col(pay))).alias("z_next"),
        )
    )
    mechanical = F.col("next") * (F.col("z_last") - F.col("z_next"))
    taxed = row.select(
        "*", mechanical.alias("mechanical_cost"), ratio(mechanical * cost_extension, F.col("employed")).alias("tax")
    )
    raised = taxed.withColumn(
        "benefit_change", ratio(F.col("tax") * F.col("employed") / cost_increase, F.col("covered"))
    )
    return raised.select(
        *by,
        "mechanical_cost",
        "tax",
        "benefit_change",
        (ratio(F.col("z0") + F.col("tax"), F.col("z0")) - 1).alias("tax_rate"),
        ratio(F.col("benefit_change"), F.col("z1")).alias("benefit_rate"),
    )


def onset_drops(history: DataFrame, agent: str, period: str, state: str, cons: str) -> DataFrame:
    """Fall in consumption from the period before to the first unemployed period.

    Agents that start in that state have no period before and drop out, and so does an
    onset whose period before is not in the history.
    """
    time = Window.partitionBy(agent).orderBy(period)
    follows = F.lag(period).over(time) == F.col(period) - 1
    moved = history.withColumn("onset_drop", F.when(follows, F.lag(cons).over(time) - F.col(cons)))
    return moved.filter((F.col(state) == 1) & F.col("onset_drop").isNotNull())


def onset_profile(history: DataFrame, agent: str, period: str, state: str, cons: str) -> DataFrame:
    """Mean consumption by state, and the quartiles and the mean of the drop at onset, long."""
    means = history.groupBy(state).agg(F.avg(cons).alias("value"))
    dropped = materialise(onset_drops(history, agent, period, state, cons).select("onset_drop"), "drops")
    drops = weighted_quantiles(
        dropped,
        [],
        "onset_drop",
        None,
        {"onset_drop_25th": 0.25, "onset_drop_50th": 0.5, "onset_drop_75th": 0.75},
        interpolate=True,
        means={"onset_drop_mean": (F.col("onset_drop"), F.lit(1))},
    )
    return means.select(
        F.concat(F.lit("cbar_"), F.col(state).cast("string")).alias("statistic"), "value"
    ).unionByName(drops.unpivot([], drops.columns, "statistic", "value"))
