"""Person-month panels and event studies.

A panel here has one row per (entity, period), so a window over one entity holds
at most as many rows as the calendar has periods, whatever the share of source
rows that entity had before it was aggregated to periods.  All windows of one
operator use the same entity partitioning, which Spark shuffles for once.
Household groups have no such bound and go through ``attach``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numbers import (
    capped,
    floor_bin,
    hashed_uniform,
    month_index,
    ratio,
    wave_month_index,
    wave_of,
    wave_start,
)
from tallyframe.functions.text import pasted, repaired_code
from tallyframe.operators.attach import attach
from tallyframe.operators.weights import weighted_quantiles
from tallyframe.session import materialise

AGE_BIN = 10
OLDEST_BIN = 70
ADULT_AGE = 18
MOST_ADULTS = 4


def build_panel(
    df: DataFrame,
    *,
    unit: str,
    entity: str,
    person: str,
    address: str,
    family: str,
    head: str,
    age: str,
    wave: str,
    ref_month: str,
    year: str,
    month: str,
    bad_wave: int,
    base_year: int,
    spread: list[str] | None = None,
) -> DataFrame:
    """Keys, month indices and household attributes for stacked wave files.

    One wave has codes with an extra leading character, which are cut back so the
    person key matches across waves.  ``hfam_age`` is the age of the family head
    (0 when no member is head).
    """
    keyed = df.select(
        "*",
        pasted(
            F.col(unit),
            repaired_code(F.col(entity), F.col(wave), bad_wave),
            repaired_code(F.col(person), F.col(wave), bad_wave),
        ).alias("id"),
        pasted(F.col(unit), F.col(address), F.col(family)).alias("id_fam"),
        wave_month_index(F.col(wave), F.col(ref_month)).alias("period_index"),
        month_index(F.col(year), F.col(month), base_year).alias("period_index_cal"),
        F.coalesce(F.col(person).try_cast("double") == F.col(head), F.lit(False)).alias("fam_head"),
    )
    with_family = attach(
        keyed,
        ["id_fam", "period_index"],
        [
            F.max(F.when(F.col("fam_head"), F.col(age)).otherwise(0)).alias("hfam_age"),
            F.count(F.lit(1)).alias("n_members"),
            F.count_if(F.col(age) >= ADULT_AGE).alias("n_adults_raw"),
        ],
        spread=spread or ["id", "period_index"],
    )
    return with_family.select(
        "*",
        floor_bin(F.col("hfam_age"), AGE_BIN, top=OLDEST_BIN).alias("hfam_age_bin"),
        capped(F.col("n_adults_raw"), MOST_ADULTS).alias("n_adults"),
    ).drop("n_adults_raw")


def price_index(prices: DataFrame, period: str, price: str) -> DataFrame:
    """(period, index): the factor that turns amounts into last-period money.

    The prices are written once: the last price and every row come from that table.
    """
    prices = materialise(prices.select(period, price), "prices")
    last = prices.agg(F.max_by(price, period))
    return prices.select(period, ratio(last.scalar(), F.col(price)).alias("price_index"))


def deflate(
    panel: DataFrame, prices: DataFrame, on: str, period: str, price: str, amounts: list[str], suffix: str = "_adj"
) -> DataFrame:
    """Amounts in last-period money; ``on`` is the panel's month column to match.

    With one row per month the written prices are small enough for Spark's own size
    check to broadcast them, so the panel is not shuffled by month.
    """
    index = price_index(prices, period, price).withColumnRenamed(period, "__period")
    joined = panel.join(index, F.col(on) == F.col("__period"), "left").drop("__period")
    return joined.select(
        "*", *[(F.col(a) * F.col("price_index")).alias(f"{a}{suffix}") for a in amounts]
    )


def flag_events(
    panel: DataFrame,
    entity: str,
    period: str,
    flags: dict[str, Column],
    transitions: dict[str, tuple[str, Column]],
    ever: dict[str, str],
) -> DataFrame:
    """Event flags per row, moves between periods, and "ever" flags per entity.

    A transition (prior, now) is true when flag ``prior`` held on the entity's
    previous row and ``now`` holds on this one; it never crosses entities.  The
    "ever" flags skip NULL flags.
    """
    rows = Window.partitionBy(entity).orderBy(period)
    whole = Window.partitionBy(entity)
    flagged = panel.select("*", *[c.alias(n) for n, c in flags.items()])
    moved = flagged.select(
        "*",
        *[
            (F.coalesce(F.lag(prior).over(rows), F.lit(False)) & now).alias(n)
            for n, (prior, now) in transitions.items()
        ],
    )
    return moved.select("*", *[F.bool_or(flag).over(whole).alias(n) for n, flag in ever.items()])


def event_study(panel: DataFrame, entity: str, period: str, events: dict[str, str]) -> DataFrame:
    """First and last date of each event ``{prefix: flag}`` and the time around it.

    An entity without the event has NULL dates, so comparisons with them drop out.
    """
    whole = Window.partitionBy(entity)
    p = F.col(period)
    dated = panel.select(
        "*",
        *[
            pick(F.when(F.col(flag), p)).over(whole).alias(f"{which}_{name}_date")
            for name, flag in events.items()
            for which, pick in (("first", F.min), ("last", F.max))
        ],
    )
    times = []
    for name in events:
        since = p - F.col(f"first_{name}_date")
        times += [
            since.alias(f"time_since_{name}_start"),
            (p - F.col(f"last_{name}_date")).alias(f"time_since_{name}_end"),
            wave_of(F.col(f"first_{name}_date")).alias(f"first_{name}_wave"),
            wave_start(since).alias(f"{name}_t_wave"),
        ]
    return dated.select("*", *times)


def prior_window_mean(
    panel: DataFrame, entity: str, period: str, event_date: str, measures: dict[str, str], months: int = 12
) -> DataFrame:
    """Mean of measures ``{new: old}`` over the rows in the ``months`` periods before
    the event, on every row, with the number of months seen.

    A NULL amount among them makes the mean NULL: it is not known, and not zero.
    """
    whole = Window.partitionBy(entity)
    since = F.col(period) - F.col(event_date)
    inside = F.coalesce((since >= -months) & (since < 0), F.lit(False))
    seen = F.count_if(inside).over(whole)

    def mean(old: str) -> Column:
        return ratio(_known_sum(inside, F.col(old), whole), seen)

    return panel.select("*", seen.alias("mos_in_horizon"), *[mean(old).alias(new) for new, old in measures.items()])


def _known_sum(inside: Column, value: Column, over: Window) -> Column:
    """Sum of the values inside, NULL when one of them is."""
    unknown = F.count_if(inside & value.isNull()).over(over)
    return F.when(unknown == 0, F.sum(F.when(inside, value)).over(over))


def pseudo_event(
    panel: DataFrame,
    entity: str,
    period: str,
    at_risk: Column,
    earliest: int,
    seed: int,
    name: str = "pseudo_date",
) -> DataFrame:
    """A reproducible placebo date for each entity.

    Entities seen at ``earliest`` or later draw a date from ``earliest`` up to their
    last period; the date is void when the entity has no row there or is not
    ``at_risk`` then.  The draw depends on the entity key and the seed only.
    """
    whole = Window.partitionBy(entity)
    last = F.max(period).over(whole)
    draw = F.floor(earliest + hashed_uniform(F.col(entity), seed) * (last - earliest)).cast("int")
    drawn = panel.withColumn("__date", F.when(last >= earliest, draw))
    valid = F.bool_or((F.col(period) == F.col("__date")) & at_risk).over(whole)
    return drawn.withColumn(name, F.when(valid, F.col("__date"))).drop("__date")


def cohort_stack(
    panel: DataFrame,
    entity: str,
    period: str,
    cohorts: dict[str, tuple[str, Column | None]],
    measures: dict[str, str],
    window: tuple[int, int] = (15, 4),
    keep: list[str] | None = None,
) -> DataFrame:
    """Cohorts with a full window of months before their start date, stacked.

    ``cohorts`` is ``{label: (start date column, extra condition on the entity)}``.
    An entity may be in several cohorts; it is copied once per cohort, and window
    means are taken within (entity, cohort) and are NULL when an amount in the window is.
    """
    first, last = window
    months = first - last + 1
    start = F.array(
        *[
            F.struct(
                F.lit(label).alias("key"),
                (F.col(date) if extra is None else F.when(extra, F.col(date))).cast("int").alias("start_date"),
            )
            for label, (date, extra) in cohorts.items()
        ]
    )
    copied = panel.select(*(keep or panel.columns), F.inline(start)).filter("start_date IS NOT NULL")
    since = F.col(period) - F.col("start_date")
    copied = copied.withColumn("in_horizon", (since >= -first) & (since <= -last))
    group = Window.partitionBy(entity, "key")
    return copied.select(
        "*",
        F.count_if("in_horizon").over(group).alias("__seen"),
        *[
            (_known_sum(F.col("in_horizon"), F.col(old).cast("double"), group) / months).alias(new)
            for new, old in measures.items()
        ],
    ).filter(F.col("__seen") == months).drop("__seen")


def representativeness_table(
    stack: DataFrame,
    period: str,
    weight: str,
    measures: dict[str, Column],
    median: tuple[str, str],
    scaled: tuple[str, str, float, list[str]] | None = None,
) -> DataFrame:
    """Weighted means and one weighted median per cohort, at each entity's start date.

    ``median`` is (new name, column).  ``scaled`` (cohort, new label, factor,
    measures) adds a variant row whose listed means are scaled; it has no median.
    The start rows, one per entity and cohort, are written once; one scan of them gives the
    means and the cells of the median, a second one the few rows around the median.
    """
    at_start = stack.filter(F.col(period) == F.col("start_date"))
    rows = materialise(
        at_start.select(
            "key", weight, F.col(median[1]).alias("__median"), *[c.cast("double").alias(n) for n, c in measures.items()]
        ),
        "starts",
    )
    means = {n: (F.col(n), F.col(weight)) for n in measures}
    table = weighted_quantiles(rows, ["key"], "__median", weight, {median[0]: 0.5}, means=means).select("key", median[0], *measures)
    if scaled is None:
        return table
    cohort, label, factor, names = scaled
    variant = F.struct(
        F.lit(label).alias("key"),
        F.lit(None).cast("double").alias(median[0]),
        *[(F.col(m) * factor if m in names else F.col(m)).alias(m) for m in measures],
    )
    own = F.struct("key", median[0], *measures)
    copies = F.when(F.col("key") == cohort, F.array(own, variant)).otherwise(F.array(own))
    return table.select(F.inline(copies))

