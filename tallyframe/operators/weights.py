"""Weighted statistics of survey cross-sections."""

from __future__ import annotations

import math
from collections.abc import Iterable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.numbers import floor_bin, ratio
from tallyframe.operators.attach import same_key
from tallyframe.session import materialise

#: Weights are summed in whole units of a power of ten in which the largest has so many digits.
WEIGHT_DIGITS = 20
#: With ``interpolate`` a weight counts copies; their parts have so many digits.
COPY_DIGITS = 6
CELLS_PER_OCTAVE = 64
#: A cell with more different values than HEAVY is cut into FINER parts before it is put in order.
HEAVY, FINER = 1_000_000, 4096
TARGET = "decimal(38,6)"


def weighted_mean(x: Column, w: Column) -> Column:
    """Aggregate expression; a NULL value takes its weight out of the denominator."""
    value = x.cast("double")
    weight = w.cast("double")
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def weighted_share(condition: Column, w: Column, complement: bool = False) -> Column:
    """Weighted share of rows where the condition holds, or of the others."""
    share = weighted_mean(condition, w)
    return 1 - share if complement else share


def weighted_means(df: DataFrame, by: list[str], measures: list[str], weight: str) -> DataFrame:
    return df.groupBy(*by).agg(*[weighted_mean(F.col(m), F.col(weight)).alias(m) for m in measures])


def survey_facts(
    df: DataFrame, weight: str, facts: dict[str, tuple[Column, Column, bool]], derived: dict[str, Column] | None = None
) -> DataFrame:
    """One row of facts from one pass over the data.

    Each fact is (who counts, the value or condition, take the complement);
    ``derived`` are expressions over earlier fact names, evaluated in order.
    """
    row = df.agg(
        *[
            weighted_share(F.when(who, value), F.col(weight), complement).alias(name)
            for name, (who, value, complement) in facts.items()
        ]
    )
    for name, expression in (derived or {}).items():
        row = row.withColumn(name, expression)
    return row


def facts_long(row: DataFrame, name: str = "fact", value: str = "value") -> DataFrame:
    return row.unpivot([], row.columns, name, value)


def weighted_quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    weight: str | None,
    probs: dict[str, float],
    interpolate: bool = False,
    means: dict[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Quantiles per group as columns named by ``probs``.

    The default is the smallest value whose running weight reaches q times the
    total; probability 0 gives the smallest value.  ``interpolate`` reads position
    1 + (total - 1) q between the two neighbouring order statistics, which for unit
    weights is the usual linear percentile.  A group without values or weight has NULL.
    ``means`` are weighted means {name: (value, weight)} over all rows of the group,
    carried in the first read.

    The table is read twice.  First weights are summed by group and cell of an
    ordered scale (``scale_cell``), which combines before the shuffle; the cells are
    written, and from them follow the unit of the sums and the cell that holds each
    answer.  Then only the rows of those cells are read again, summed by value and put
    in order; where a cell has very many rows they are written, and cut finer if they
    have very many values.  Weights are summed as whole units (``_units``), so running
    sums are exact and compare without a tolerance.
    """
    if not by:
        whole = weighted_quantiles(df.withColumn("__all", F.lit(1)), ["__all"], value, weight, probs, interpolate, means)
        return whole.drop("__all")
    x = F.col(value).cast("double")
    w, exponent, size = _units(df, weight, interpolate)
    known = x.isNotNull()
    carried = {}
    for name, (of, with_) in (means or {}).items():
        carried[f"__{name}|sum"] = of.cast("double") * with_.cast("double")
        carried[f"__{name}|weight"] = F.when(of.isNotNull(), with_.cast("double"))
    rows = df.select(
        *by, x.alias("__x"), F.when(known, w).alias("__w"), F.when(known, exponent).alias("__e"), F.when(known, size).alias("__size"),
        *[c.alias(n) for n, c in carried.items()],
    )
    cells = rows.groupBy(*by, F.when(F.col("__w").isNotNull(), scale_cell(F.col("__x"))).alias("__cell"), "__e")
    cells = cells.agg(
        F.sum("__w").alias("__w"), F.count("__w").alias("__n"), F.max("__size").alias("__most"),
        F.min(F.when(F.col("__size") > 0, F.col("__size"))).alias("__least"), *[F.sum(f"`{n}`").alias(n) for n in carried],
    )
    cells = materialise(cells, "cells")
    top, unit, most_rows = _settled(cells, weight, interpolate)
    in_units = _in_units(top)
    rows = rows.select(*by, "__x", in_units.alias("__w"))
    sums = cells.groupBy(*by, "__cell").agg(F.sum(in_units).alias("__w"), *[F.sum(f"`{n}`").alias(n) for n in carried])
    group = Window.partitionBy(*by)
    run = group.orderBy(F.col("__cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce("__w", F.lit(0))
    ends = sums.select(*by, "__cell", F.sum(own).over(run).alias("__end"), F.sum("__w").over(group).alias("__total"), own.alias("__own"))
    wanted = _positions(probs, interpolate, unit)
    marks = F.array(*[F.struct(F.lit(n).alias("name"), t.alias("target")) for n, t in wanted.items()])
    reached = ends.filter(F.col("__cell").isNotNull()).select(
        *by, "__cell", "__end", (F.col("__end") - F.col("__own")).alias("__before"), F.col("__total"), F.inline(marks)
    )
    reached = reached.filter((F.col("__total") > 0) & (F.col("__end") >= F.col("target")))
    first = F.min(F.struct("__cell", "__before", "target")).alias("__at")
    holds = reached.groupBy(*by, "name").agg(first).select(*by, "name", "__at.*").withColumnRenamed("__cell", "__at")
    # the cells asked for are a few per group; their rows are summed by value before the shuffle
    inside = rows.filter(F.col("__w").isNotNull()).withColumn("__at", scale_cell(F.col("__x")))
    if most_rows <= HEAVY:
        marks = [F.first(c).alias(c) for c in ["__before", *map(_target, wanted)]]
        inside = _marked(inside, holds, wanted, by).groupBy(*by, "__at", "__x").agg(F.sum("__w").alias("__w"), *marks)
    else:
        holds = materialise(holds, "held")
        inside = materialise(_marked(inside, holds, [], by).groupBy(*by, "__at", "__x").agg(F.sum("__w").alias("__w")), "inside")
        while not (heavy := _heavy(inside, by)).isEmpty():
            inside, holds = _finer(inside, holds, heavy, wanted, by)
        inside = _marked(inside, holds, wanted, by)
    found = _with_ends(inside, "__x", by)
    found = found.groupBy(*by).agg(*[F.min(F.when(_is_reached("__x", n), F.col("__x"))).alias(n) for n in wanted])
    averages = [F.try_divide(F.sum(f"`__{n}|sum`"), F.sum(f"`__{n}|weight`")).alias(n) for n in means or {}]
    groups = sums.groupBy(*[F.col(k).alias(f"__g_{k}") for k in by]).agg(F.sum("__w").alias("__total"), *averages)
    both = groups.join(found, same_key([F.col(f"__g_{k}") for k in by], [F.col(k) for k in by]), "left")
    keys = [F.col(f"__g_{k}").alias(k) for k in by]
    if not interpolate:
        return both.select(*keys, *probs, *(means or {}))
    out = []
    for name, q in probs.items():
        part = F.pmod(_position(q, unit), unit).cast("double") / unit.cast("double")
        out.append(((1 - part) * F.col(f"{name}|lo") + part * F.col(f"{name}|hi")).alias(name))
    return both.select(*keys, *out, *(means or {}))


def scale_cell(x: Column) -> Column:
    """A whole number that never falls as ``x`` rises: ``CELLS_PER_OCTAVE`` cells for each doubling."""
    size = F.abs(x)
    step = F.floor(F.log2(size) * CELLS_PER_OCTAVE) + 2048 * CELLS_PER_OCTAVE
    step = F.when(size == float("inf"), 4096 * CELLS_PER_OCTAVE).otherwise(step)
    return F.when(F.isnan(x), 8192 * CELLS_PER_OCTAVE).when(x > 0, step).when(x < 0, -step).otherwise(F.when(x == 0, 0)).cast("int")


def _exact(q: float) -> Column:
    return F.lit(Decimal(repr(float(q))))


def _units(df: DataFrame, weight: str | None, copies: bool) -> tuple[Column, Column, Column]:
    """A row's weight in whole units of its own, the power of ten these units follow, and its size.

    A weight that is no whole number is written with ``WEIGHT_DIGITS`` digits, so it is exact
    whatever its size; sums of weights of one power are exact too, and are brought to the unit
    of the largest one later (``_in_units``).  Where weights count ``copies`` the unit is fixed,
    ``COPY_DIGITS`` digits after the point.  NaN and infinite weights count as unknown.
    """
    kind, none = f"decimal({WEIGHT_DIGITS + 2},0)", F.lit(None).cast("int")
    if weight is None:
        return F.lit(1).cast(kind), none, none.cast("double")
    if isinstance(df.schema[weight].dataType, T.IntegralType):
        return F.col(weight).cast(kind), none, none.cast("double")
    size = F.abs(F.col(weight).cast("double"))
    size = F.when(size < float("inf"), size)
    text = F.col(weight).cast("string")
    power = F.when(F.instr(text, "E") > 0, F.substring_index(text, "E", -1)).otherwise("0").try_cast("int")
    exponent = none if copies else F.floor(F.log10(size)).cast("int")
    power = power + (F.lit(COPY_DIGITS) if copies else F.lit(WEIGHT_DIGITS - 1) - F.coalesce(exponent, F.lit(0)))
    units = F.concat(F.substring_index(text, "E", 1), F.lit("E"), power.cast("string")).try_cast(kind)
    return units, exponent, size


def _settled(cells: DataFrame, weight: str | None, copies: bool) -> tuple[int | None, Column, int]:
    """The largest power of ten among weights, the units in a weight of 1 where weights count copies, and most rows of a cell.

    A weight that is not 0 but would round to 0, or one that does not fit, is an error.
    """
    row = cells.agg(F.max("__e").alias("top"), F.max("__most").alias("most"), F.min("__least").alias("least"), F.max("__n").alias("n")).first()
    unit = F.lit(Decimal(10**COPY_DIGITS)) if copies and row["most"] is not None else F.lit(1).cast("decimal(1,0)")
    if row["least"] is not None:
        shift = COPY_DIGITS if copies else WEIGHT_DIGITS - 1 - row["top"]
        if math.log10(row["least"]) + shift < math.log10(0.5) or math.log10(row["most"]) + shift > WEIGHT_DIGITS + 1:
            raise ValueError(f"weights of {weight} from {row['least']} to {row['most']} do not fit sums in units of 1e{-shift}")
    return row["top"], unit, row["n"] or 0


def _in_units(top: int | None) -> Column:
    """``__w`` of power ``__e`` in units of the power ``top``; parts below a unit are rounded."""
    if top is None:
        return F.col("__w")
    moved = F.concat(F.col("__w").cast("string"), F.lit("E"), (F.col("__e") - top).cast("string")).cast("decimal(38,0)")
    return F.when(F.col("__e") < top, moved).otherwise(F.col("__w").cast("decimal(38,0)"))


def _target(name: str) -> str:
    return f"__t_{name}"


def _marked(rows: DataFrame, holds: DataFrame, names: Iterable[str], by: list[str]) -> DataFrame:
    """The rows (group, __at) of cells that hold an answer, with the weight __before the cell and the targets ``names`` in it."""
    targets = [F.max(F.when(F.col("name") == n, F.col("target"))).alias(_target(n)) for n in names]
    marks = holds.groupBy(*[F.col(k).alias(f"__c_{k}") for k in by], F.col("__at").alias("__c_at")).agg(F.first("__before").alias("__before"), *targets)
    on = same_key([F.col(k) for k in by], [F.col(f"__c_{k}") for k in by]) & (F.col("__at") == F.col("__c_at"))
    return rows.join(marks, on).select(*rows.columns, "__before", *map(_target, names))


def _with_ends(sums: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Marked sums with the running weight up to their end, __end, and the last place of their cell, __last."""
    cell = Window.partitionBy(*by, "__at")
    run = F.sum("__w").over(cell.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumns({"__end": F.col("__before") + run, "__last": F.max(order).over(cell)})


def _is_reached(order: str, name: str) -> Column:
    """Whether a target of the cell is reached here.

    A cell's last row always reaches it: parts of weights below a unit may round otherwise
    here than in the cell's own sum.
    """
    target = F.col(_target(name))
    return target.isNotNull() & ((F.col("__end") >= target) | (F.col(order) == F.col("__last")))


def _heavy(inside: DataFrame, by: list[str]) -> DataFrame:
    """Cells of more than ``HEAVY`` different values, with the smallest and the largest."""
    ends = inside.groupBy(*by, "__at").agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    ends = ends.filter((F.col("__n") > HEAVY) & (F.col("__lo") < F.col("__hi")))
    names = {**{k: f"__h_{k}" for k in by}, "__at": "__h_at"}
    return materialise(ends.withColumnsRenamed(names), "heavy")


def _finer(inside: DataFrame, holds: DataFrame, heavy: DataFrame, names: Iterable[str], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``inside`` and ``holds`` with heavy cells cut into ``FINER`` equal parts, others left whole."""
    on = same_key([F.col(k) for k in by], [F.col(f"__h_{k}") for k in by]) & (F.col("__at") == F.col("__h_at"))
    part = F.floor((F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (FINER - 1)).cast("int")
    # heavy cells are at most a millionth of the rows
    cut = inside.join(F.broadcast(heavy), on, "left").select(*by, "__at", "__x", "__w", F.coalesce(part, F.lit(0)).alias("__part"))
    sums = cut.groupBy(*by, "__at", "__part").agg(F.sum("__w").alias("__w"))
    ends = _with_ends(_marked(sums, holds, names, by), "__part", by)
    targets = F.array(*[F.struct(F.lit(n).alias("name"), F.col(_target(n)).alias("target"), _is_reached("__part", n).alias("hit")) for n in names])
    ends = ends.select(*by, "__at", "__part", (F.col("__end") - F.col("__w")).alias("__before"), F.inline(targets)).filter("hit")
    ends = ends.groupBy(*by, "__at", "name").agg(F.min(F.struct("__part", "__before", "target")).alias("__first"))
    inner = F.struct(F.col("__at").alias("cell"), F.col("__first.__part").alias("part")).alias("__at")
    holds = materialise(ends.select(*by, "name", inner, "__first.__before", "__first.target"), "held")
    cut = cut.withColumn("__at", F.struct(F.col("__at").alias("cell"), F.col("__part").alias("part"))).drop("__part")
    return materialise(_marked(cut, holds, [], by).drop("__before"), "inside"), holds


def _position(q: float, unit: Column) -> Column:
    """1 + (total - 1) q, in units."""
    return _exact(q) * (F.col("__total") - unit).cast("decimal(32,0)") + unit


def _positions(probs: dict[str, float], interpolate: bool, unit: Column) -> dict[str, Column]:
    """The running weights to look for, in terms of the group's total."""
    total, out = F.col("__total"), {}
    for name, q in probs.items():
        if interpolate:
            low = F.greatest(_position(q, unit) - F.pmod(_position(q, unit), unit), unit)
            out[f"{name}|lo"] = low.cast(TARGET)
            out[f"{name}|hi"] = F.least(low + unit, total).cast(TARGET)
        else:
            out[name] = (_exact(q) * total.cast("decimal(32,0)")).cast(TARGET)
    return out


def weighted_summary(df: DataFrame, weight: str, measures: list[str], probs: dict[str, float]) -> DataFrame:
    """Rows (measure, quantiles..., mean), rounded half-even to whole units."""
    long = df.unpivot([weight], measures, "measure", "__value")
    both = weighted_quantiles(long, ["measure"], "__value", weight, probs, means={"mean": (F.col("__value"), F.col(weight))})
    return both.select("measure", *[F.bround(c, 0).alias(c) for c in [*probs, "mean"]])


def weighted_histogram(
    df: DataFrame, value: str, weight: str, width: float, top: float | None = None, bottom: float | None = None
) -> DataFrame:
    return df.groupBy(floor_bin(F.col(value), width, top, bottom).alias("bin")).agg(F.sum(weight).alias("weight"))


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Each row's part of the column total; the total is a one-value subquery."""
    total = df.agg(F.sum(value))
    return df.withColumn(name, ratio(F.col(value), total.scalar()))


def binned_distribution(
    df: DataFrame, value: str, weight: str, width: float, top: float | None = None, bottom: float | None = None
) -> DataFrame:
    return share_of_total(weighted_histogram(df, value, weight, width, top, bottom), "weight")


def multi_distribution(parts: list[tuple[DataFrame, str, dict[str, Column]]]) -> DataFrame:
    """Binned distributions side by side, matched on the bin.

    Each part is (table, weight column, {label: bin expression}).  A table is read
    once for all its labels; bins that only some distributions have stay, with
    NULL elsewhere.
    """
    labels = [label for _, _, bins in parts for label in bins]
    binned = []
    for df, weight, bins in parts:
        cells = F.array(*[F.struct(F.lit(n).alias("label"), b.alias("bin")) for n, b in bins.items()])
        binned.append(df.select(F.inline(cells), F.col(weight).alias("__w")).groupBy("label", "bin").agg(F.sum("__w").alias("weight")))
    # a row per label and bin from here on, so the window has a label's bins only
    stacked = reduce(DataFrame.unionByName, binned)
    total = F.sum("weight").over(Window.partitionBy("label"))
    shares = stacked.withColumn("share", ratio(F.col("weight"), total))
    return shares.groupBy("bin").agg(
        *[
            F.max(F.when(F.col("label") == n, F.col(c))).alias(f"{prefix}_{n}")
            for n in labels
            for prefix, c in (("wt", "weight"), ("pct", "share"))
        ]
    )


def population_total(amount: Column, weight: Column, scale: float | Column) -> Column:
    """Aggregate expression: weighted total blown up to the population."""
    return F.sum(amount * weight) * scale
