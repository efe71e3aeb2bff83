"""Spending by category compared across sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numbers import ratio
from tallyframe.functions.text import money_to_double, percent_text
from tallyframe.operators.attach import attach, rows_at_max
from tallyframe.operators.ordered import in_pieces, lagged, numbered
from tallyframe.operators.reshape import collapsed, level_order, long, map_columns, total_row, wide
from tallyframe.session import materialise


def code_spend(
    df: DataFrame,
    labels: DataFrame,
    *,
    code: str,
    dollars: str,
    group: str,
    label: str,
    customer_months: float,
    excluded: list,
) -> DataFrame:
    """Spending per merchant code: sign flipped, per customer month, with a label.

    A code that appears more than once keeps its largest amount, ties included.
    ``labels`` has one label per code.
    """
    clean = df.select(
        F.col(code),
        (-F.col(dollars)).alias("dollars"),
        (-F.col(dollars) / customer_months).alias("spend_month"),
        F.trim(F.col(group)).alias(group),
    ).filter(F.col(code).isNotNull() & F.col(group).isNotNull() & ~F.col(code).isin(excluded))
    return rows_at_max(clean, [code], "dollars").join(labels.select(code, label), code, "left")


def benchmark_lines(
    mapping: DataFrame,
    benchmark: DataFrame,
    *,
    category: str,
    line_columns: list[str],
    line: str,
    amount: str,
    name: str,
    divisor: float = 1.0,
) -> DataFrame:
    """Sum of the benchmark lines that a category lists in its wide line columns.

    A category whose lines are all missing from the benchmark has amount 0.
    """
    listed = long(mapping, [category], line_columns, "__slot", line)
    matched = listed.join(benchmark.select(line, amount), line, "left")
    return matched.groupBy(category).agg((F.coalesce(F.sum(amount), F.lit(0.0)) / divisor).alias(name))


def align_offset_rows(
    df: DataFrame, *, source: str, order: str, label: str, value: str, headings: list[str]
) -> DataFrame:
    """A label that stands one row above its amount, put on the amount's row.

    Rows without label or amount drop out, as do ``headings``; what is left is
    numbered from 1 per source file.
    """
    pieces = in_pieces(df.select(source, order, label, value), [source], [order])
    moved = lagged(pieces, [source], [order], label, "item")
    amounts = moved.withColumn("amount", money_to_double(F.col(value))).dropna(subset=["item", "amount"])
    kept = amounts.filter(~F.col("item").isin(headings))
    return numbered(kept, [source], [order], "line").select(source, "line", "item", "amount")


def reallocate(
    amounts: DataFrame, sources: DataFrame, rules: DataFrame, category: str, amount: str
) -> DataFrame:
    """Move fractions of source buckets between categories, one stage at a time.

    ``sources`` (source, amount) is the snapshot before the stage; ``rules`` is
    (category, source, coef, mode).  The new amount is the sum of coef x source,
    plus the old amount when the mode is ``add``, in its place when it is ``set``.
    A missing source adds nothing; a ``set`` rule with no source at all gives NULL.
    Rows of one stage never see each other's results.
    """
    priced = rules.join(sources.withColumnRenamed(amount, "__source"), "source", "left")
    change = priced.groupBy(category).agg(
        F.sum(F.col("coef") * F.col("__source")).alias("__change"),
        F.bool_or(F.col("mode") == "set").alias("__set"),
    )
    new = F.when(F.col("__set"), F.col("__change")).otherwise(
        F.col(amount) + F.coalesce("__change", F.lit(0.0))
    )
    return amounts.join(change, category, "left").withColumn(amount, new).drop("__change", "__set")


def coverage_table(
    options: DataFrame,
    amounts: dict[str, DataFrame],
    *,
    category: str,
    group: str,
    group_levels: list[str],
    ratios: dict[str, tuple[str, str]],
    shares: dict[str, str] | None = None,
    merge: dict[str, list | str] | None = None,
    complete_only: bool = False,
) -> DataFrame:
    """Amounts by category from several sources with shares and coverage ratios.

    ``amounts`` is ``{column: table of (category, column)}``, one row per category.
    ``merge`` collapses categories first; a merged category is looked up in
    ``options`` like any other.  Shares and ratios are taken before amounts are
    rounded.  ``complete_only`` drops rows without a group and rows where every
    amount is 0 or missing.  Rows come in the order of ``group_levels``.
    """
    names = list(amounts)
    cells = reduce(
        DataFrame.unionByName,
        [
            t.select(F.col(category).alias("__category"), *[(F.col(n) if n == m else F.lit(None).cast("double")).alias(m) for m in names])
            for n, t in amounts.items()
        ],
    )
    level = collapsed(F.col("__category"), merge) if merge else F.col("__category")
    sums = cells.groupBy(level.alias("__category")).agg(*[F.sum(n).alias(n) for n in names])
    shared = sums
    for name, column in (shares or {}).items():
        shared = shared.withColumn(name, ratio(F.col(column), sums.agg(F.sum(column)).scalar()))
    table = options.select(group, category).join(shared, F.col(category) == F.col("__category"), "left").drop("__category")
    if complete_only:
        spent = reduce(Column.__or__, [F.coalesce(F.col(n), F.lit(0.0)) != 0 for n in names])
        table = table.filter(F.col(group).isNotNull() & spent)
    table = table.select("*", *[ratio(F.col(a), F.col(b)).alias(n) for n, (a, b) in ratios.items()])
    rounded = map_columns(table, lambda c: c in names, lambda c: F.bround(c, 0))
    rounded = map_columns(rounded, lambda c: c in ratios or c in (shares or {}), lambda c: F.bround(c, 2))
    return rounded.withColumn("sort_key", level_order(F.col(group), group_levels)).orderBy("sort_key", category)


def region_flag(shapes: DataFrame, attributes: DataFrame, region: str, flag: Column, name: str) -> DataFrame:
    """A region attribute on every outline row."""
    return shapes.join(attributes.select(region, flag.alias(name)), region, "left")


def currency_group_mean(df: DataFrame, by: str, money: str, name: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(money_to_double(F.col(money))).alias(name))


def rate_rescaled(
    df: DataFrame, person: str, day: str, amount: str, days: int, name: str, spread: list[str] | None = None
) -> DataFrame:
    """Amounts of a diary blown up from the days a person was active to ``days``."""
    active = (F.max(day) - F.min(day) + 1).alias("days_active")
    return attach(df, [person], [active], spread).withColumn(name, F.col(amount) * days / F.col("days_active"))


def category_share(
    df: DataFrame, *, level: Column, amount: str, weight: str, scale: float, levels: list[str], digits: int = 3
) -> DataFrame:
    """Weighted category totals as rounded shares in the order of ``levels``."""
    totals = (
        df.groupBy(level.alias("category"))
        .agg((F.sum(F.col(amount) * F.col(weight)) * scale).alias("total"))
        .dropna("any")
    )
    shares = totals.select("category", F.bround(ratio(F.col("total"), totals.agg(F.sum("total")).scalar()), digits).alias("ratio"))
    return shares.withColumn("sort_key", level_order(F.col("category"), levels)).orderBy("sort_key")


def payment_mix(
    df: DataFrame,
    *,
    person: str,
    day: str,
    amount: str,
    weight: str,
    payment: Column,
    category: Column,
    payment_levels: list[str],
    category_levels: list[str],
    nondurable: list[str],
    durable: list[str],
    base: list[str],
    scale: float,
    days: int = 31,
) -> DataFrame:
    """Monthly household spending by payment and category, as percent texts.

    Amounts are blown up from each person's active days to ``days``.  The scaling
    is linear per person, so the diary is summed to (person, payment, category)
    first; the active days and the number of persons come from those few rows per
    person, without reading the diary again.
    """
    per_person = df.groupBy(person, payment.alias("payment"), category.alias("category")).agg(
        F.sum(F.col(amount) * F.col(weight)).alias("__spend"), F.min(day).alias("__first"), F.max(day).alias("__last")
    )
    whole = Window.partitionBy(person)
    active = F.max("__last").over(whole) - F.min("__first").over(whole) + 1
    one_per_person = F.row_number().over(whole.orderBy("payment", "category")) == 1
    monthly = per_person.select(
        "payment", "category", (F.col("__spend") * days / active).alias("__spend"), one_per_person.alias("__person")
    )
    # from here on there is one row per payment and category
    sums = materialise(
        monthly.groupBy("payment", "category").agg(
            F.sum("__spend").alias("__spend"), F.count_if("__person").alias("__people")
        ),
        "payments",
    )
    people = sums.agg(F.sum("__people")).scalar()
    cells = sums.select("payment", "category", ratio(F.col("__spend") * scale, people).alias("__spend")).filter(
        "payment IS NOT NULL AND category IS NOT NULL"
    )
    table = wide(cells, ["payment"], "category", category_levels, F.sum("__spend"), round_to=2)
    table = total_row(table, "payment", category_levels)

    def plus(names: list[str]) -> Column:
        return reduce(Column.__add__, [F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names])

    shares = table.select(
        "payment",
        ratio(plus(nondurable), plus(base)).alias("nondurable_share"),
        ratio(plus(durable), plus(base)).alias("durable_share"),
    )
    shares = shares.withColumn("consump_share", F.col("nondurable_share") + F.col("durable_share"))
    shares = shares.withColumn("other_share", 1 - F.col("consump_share"))
    text = map_columns(shares, lambda c: c.endswith("_share"), percent_text)
    return text.withColumn("sort_key", level_order(F.col("payment"), [*payment_levels, "Total"])).orderBy("sort_key")
