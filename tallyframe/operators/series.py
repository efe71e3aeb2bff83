"""Series by period: rebasing, chained indices, evolving composition, fit.

Tables here have one row per (series or type, period); a window over a series
holds as many rows as there are periods, one over a period as many as types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numbers import band, ratio, se_from_band
from tallyframe.operators.attach import same_key


def over_time(series: list[str], period: str):
    return Window.partitionBy(*series).orderBy(period)


def pct_change(x: Column, window) -> Column:
    return ratio(x, F.lag(x).over(window)) - 1


def running_product(x: Column, window) -> Column:
    """Product of the values up to this row; exact zeros stay zero."""
    return F.product(x).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def rebased(df: DataFrame, series: list[str], period: str, value: str, at: Column | None, name: str) -> DataFrame:
    """Each series over its own value at period ``at``, or at its last period."""
    whole = Window.partitionBy(*series)
    base = F.max_by(value, period).over(whole) if at is None else F.max(F.when(F.col(period) == at, F.col(value))).over(whole)
    return df.withColumn(name, ratio(F.col(value), base))


def chain_index(df: DataFrame, series: list[str], period: str, growth: str, base: int, name: str) -> DataFrame:
    """Growth rates chained forwards and backwards from 1 at the base period.

    The index is the product of (1 + growth) up to a period over the same product
    at the base.  A growth of -100% makes the earlier periods NULL.
    """
    time = over_time(series, period)
    factor = 1 + F.coalesce(growth, F.lit(0.0))
    running = df.withColumn("__level", running_product(factor, time))
    at_base = F.max(F.when(F.col(period) == base, F.col("__level"))).over(Window.partitionBy(*series))
    return running.withColumn(name, ratio(F.col("__level"), at_base)).drop("__level")


def type_shares(
    df: DataFrame, series: list[str], type_: str, period: str, cons: str, hazard: str, weight: str
) -> DataFrame:
    """How the mix of types moves as each type leaves at its own hazard.

    ``weight`` is the type's share at the start.  Adds the part of the starting
    population that is left (``remaining``), the type's share of the period
    (``share``) and the growth of its consumption (``growth``).
    """
    time = over_time([*series, type_], period)
    period_total = Window.partitionBy(*series, period)
    left = df.withColumn("__stay", 1 - F.coalesce(F.lag(hazard).over(time), F.lit(0.0)))
    left = left.select(
        "*",
        (F.col(weight) * running_product(F.col("__stay"), time)).alias("remaining"),
        pct_change(F.col(cons), time).alias("growth"),
    ).drop("__stay")
    return left.withColumn("share", ratio(F.col("remaining"), F.sum("remaining").over(period_total)))


def composition_series(
    df: DataFrame,
    series: list[str],
    type_: str,
    period: str,
    cons: str,
    hazard: str,
    weight: str,
    base: int,
    normalise: bool = True,
) -> DataFrame:
    """Share-weighted consumption index and hazard of a changing population.

    Growth is averaged over types with the shares of the period and then chained,
    so the index moves with behaviour and not with the mix.  Without
    ``normalise`` the index starts from the share-weighted level at the base.
    """
    detail = type_shares(df, series, type_, period, cons, hazard, weight)
    mixed = detail.groupBy(*series, period).agg(
        F.coalesce(F.sum(F.col("growth") * F.col("share")), F.lit(0.0)).alias("growth"),
        F.sum(F.col(hazard) * F.col("share")).alias("hazard"),
        F.sum(F.col(cons) * F.col("share")).alias("level"),
    )
    out = chain_index(mixed, series, period, "growth", base, "cons_index")
    if not normalise:
        start = F.max(F.when(F.col(period) == base, F.col("level"))).over(Window.partitionBy(*series))
        out = out.withColumn("cons_index", F.col("cons_index") * start)
    return out.select(*series, period, "cons_index", "hazard")


def share_of_types(detail: DataFrame, series: list[str], type_: str, period: str, types: list, name: str) -> DataFrame:
    """Share of the given types in each period, from ``type_shares``."""
    return detail.groupBy(*series, period).agg(
        F.sum(F.when(F.col(type_).isin(types), F.col("share")).otherwise(0.0)).alias(name)
    )


def fit_distance(
    model: DataFrame, target: DataFrame, by: list[str], series: str, period: str, value: str, se: str
) -> DataFrame:
    """Sum of squared standardised gaps to the target, by series and in total.

    The total row has NULL in ``series``.  ``undefined`` counts the terms that have no
    value: periods that only the model or only the target has, missing values, and
    standard errors that are NULL or zero.  With any of them the distance is NULL, not
    the smaller sum of the rest.
    """
    t = target.select(series, period, F.col(value).alias("__target"), F.col(se).alias("__se"), F.lit(1).alias("__in"))
    gap = ratio(F.col(value) - F.col("__target"), F.col("__se"))
    squared = model.join(t, [series, period], "left").select(*by, series, (gap * gap).alias("__d"), "__in")
    sums = squared.groupBy(*by, series).agg(
        F.sum("__d").alias("__d"), F.count_if(F.col("__d").isNull()).alias("__open"), F.count("__in").alias("__met")
    )
    wanted = target.groupBy(F.col(series).alias("__series")).agg(F.count(F.lit(1)).alias("__of"))
    by_series = sums.join(wanted, F.col(series) == F.col("__series"), "left").select(
        *by, series, "__d", (F.col("__open") + F.coalesce("__of", F.lit(0)) - F.col("__met")).alias("undefined")
    )
    parts = F.array(F.col(series), F.lit(None).cast("string"))
    return (
        by_series.select(*by, F.explode(parts).alias(series), "__d", "undefined")
        .groupBy(*by, series)
        .agg(F.sum("undefined").alias("undefined"), F.sum("__d").alias("__d"))
        .select(*by, series, F.when(F.col("undefined") == 0, F.col("__d")).alias("distance"), "undefined")
    )


def target_moments(
    moments: DataFrame,
    longest: DataFrame,
    *,
    digits: int | dict[str, int] = 3,
    se_digits: int | dict[str, int] = 6,
    repair: list[str] | None = None,
) -> DataFrame:
    """Moments (series, period, value, se, low, high) as aligned target vectors.

    Values are rounded half-even; digits are given for all series or by series (others
    are left unrounded).  Without a standard error it is taken from the band.  The first
    error of the series in ``repair`` is replaced by the second, that of others stays.
    Shorter series are padded in front to the length in the one-row table ``longest``,
    so the last positions of all series match.
    """
    time = over_time(["series"], "period")
    whole = Window.partitionBy("series")

    def rounded(column: Column, places: int | dict[str, int]) -> Column:
        if isinstance(places, int):
            return F.bround(column, places)
        out = column
        for name, n in places.items():
            out = F.when(F.col("series") == name, F.bround(column, n)).otherwise(out)
        return out

    se = rounded(F.coalesce("se", se_from_band(F.col("low"), F.col("high"))), se_digits)
    rows = moments.select(
        "series",
        rounded(F.col("value"), digits).alias("value"),
        se.alias("__se"),
        F.row_number().over(time).alias("__n"),
        F.count(F.lit(1)).over(whole).alias("__len"),
        F.lead(se).over(time).alias("__next"),
    )
    mended = (F.col("__n") == 1) & F.col("series").isin(repair or [])
    repaired = F.when(mended, F.coalesce("__next", "__se")).otherwise(F.col("__se"))
    pad = (longest.scalar() - F.col("__len")).cast("int")
    placed = rows.select(
        "series", (F.col("__n") + pad).cast("int").alias("position"), "value", repaired.alias("se"), pad.alias("__pad"), "__n"
    )
    none = F.lit(None).cast("double")
    blanks = F.transform(
        F.sequence(F.lit(1), F.col("__pad")),
        lambda i: F.struct(i.cast("int").alias("position"), none.alias("value"), none.alias("se")),
    )
    own = F.array(F.struct("position", "value", "se"))
    cells = F.when((F.col("__n") == 1) & (F.col("__pad") > 0), F.concat(blanks, own)).otherwise(own)
    return placed.select("series", F.inline(cells))


def type_mixture(df: DataFrame, keys: list[str], dimensions: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """Every combination of types, weighted by the product of their shares.

    ``dimensions`` is ``{parameter: (low value, high value, share of low)}`` in
    columns of the row; a NULL high value means one level of share 1.  Each row
    unfolds into its type rows in place.  ``type`` numbers them from 0, the last
    dimension varying fastest.
    """
    out = df.select(
        *keys,
        *[F.struct(lo.alias("lo"), hi.alias("hi"), w.alias("w")).alias(f"__{d}") for d, (lo, hi, w) in dimensions.items()],
        F.lit(0).alias("type"),
        F.lit(1.0).alias("weight"),
    )
    done: list[str] = []
    for d in dimensions:
        low, high, share = (F.col(f"__{d}")[part] for part in ("lo", "hi", "w"))

        def level(value: Column, part: Column, number: int) -> Column:
            return F.struct(value.alias(d), part.cast("double").alias("__w"), F.lit(number).alias("__n"))

        two = F.array(level(low, share, 0), level(high, 1 - share, 1))
        levels = F.when(high.isNotNull(), two).otherwise(F.array(level(low, F.lit(1.0), 0)))
        waiting = [f"__{x}" for x in dimensions if x != d and x not in done]
        out = out.select(*keys, *done, *waiting, "type", "weight", F.size(levels).alias("__of"), F.inline(levels))
        out = out.select(
            *keys,
            *done,
            d,
            *waiting,
            (F.col("type") * F.col("__of") + F.col("__n")).alias("type"),
            (F.col("weight") * F.col("__w")).alias("weight"),
        )
        done.append(d)
    return out.select(*keys, "type", *done, "weight")


def series_long(targets: DataFrame, models: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """Targets with bands and models with zero-width bands in one long table.

    ``targets`` (series, period, value, se); ``models`` (name, series, period,
    value); ``fit`` (name, series, distance) adds the whole distance to the label,
    where it is known.
    """
    low, high = band(F.col("value"), F.col("se"))
    data = targets.select(
        "series", "period", "value", low.alias("lower"), high.alias("upper"), F.lit("Data").alias("label")
    )
    label: Column = F.col("name")
    if fit is not None:
        models = models.join(fit, ["name", "series"], "left")
        label = F.coalesce(F.concat("name", F.lit(", GOF="), F.col("distance").cast("long").cast("string")), F.col("name"))
    drawn = models.select(
        "series", "period", "value", F.col("value").alias("lower"), F.col("value").alias("upper"), label.alias("label")
    )
    return data.unionByName(drawn)


def unmatched_periods(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two series has."""
    left = a.select(*keys).distinct().withColumn("__a", F.lit(1))
    right = b.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__b", F.lit(1))
    both = left.join(right, same_key([left[k] for k in keys], [right[f"__{k}"] for k in keys]), "full")
    one_sided = both.filter("__a IS NULL OR __b IS NULL")
    return one_sided.select(
        *[F.coalesce(k, f"__{k}").alias(k) for k in keys], F.when(F.col("__a").isNull(), "right").otherwise("left").alias("only_in")
    )

