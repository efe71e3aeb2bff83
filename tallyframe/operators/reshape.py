"""Columns by pattern, wide and long, levels and total rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def map_columns(df: DataFrame, chosen: Callable[[str], bool], change: Callable[[Column], Column]) -> DataFrame:
    """Apply one change to every column whose name is chosen."""
    return df.select(*[change(F.col(f"`{c}`")).alias(c) if chosen(c) else F.col(f"`{c}`") for c in df.columns])


def wide(df: DataFrame, by: list[str], column: str, levels: list, value: Column, round_to: int | None = None) -> DataFrame:
    """Long to wide with the levels given, so no extra job looks for them."""
    out = df.groupBy(*by).pivot(column, levels).agg(value)
    if round_to is None:
        return out
    return map_columns(out, lambda c: c not in by, lambda c: F.bround(c, round_to))


def long(df: DataFrame, by: list[str], columns: list[str], name: str, value: str, keep_null: bool = False) -> DataFrame:
    out = df.unpivot(by, columns, name, value)
    return out if keep_null else out.filter(F.col(value).isNotNull())


def total_row(df: DataFrame, label: str, values: list[str], total: str = "Total") -> DataFrame:
    """The table and one more row with column sums; NULL cells count as nothing.

    ``label`` must be unique and not NULL, as it is in a finished table.
    """
    both = df.rollup(label).agg(*[F.sum(v).alias(v) for v in values], F.grouping(label).alias("__total"))
    name = F.when(F.col("__total") == 1, F.lit(total)).otherwise(F.col(label))
    return both.select(name.alias(label), *values)


def collapsed(level: Column, groups: dict[str, list | str]) -> Column:
    """Many levels to few, ``{new: [old, ...]}``; a level not listed stays as it is."""
    text = level.cast("string")
    out = text
    for new, olds in groups.items():
        out = F.when(text.isin([olds] if isinstance(olds, str) else list(olds)), F.lit(new)).otherwise(out)
    return out


def recoded(level: Column, names: dict[str, str]) -> Column:
    """New names ``{old: new}``; others stay."""
    groups: dict[str, list] = {}
    for old, new in names.items():
        groups.setdefault(new, []).append(old)
    return collapsed(level, groups)


def level_order(level: Column, levels: list[str]) -> Column:
    """1 for the first listed level and so on; NULL for any other."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), level), F.lit(0)).cast("int")


def sorted_by_level(df: DataFrame, column: str, levels: list[str], *then: str) -> DataFrame:
    """Rows in the custom order of a column's levels, the position kept visible."""
    return df.withColumn("sort_key", level_order(F.col(column), levels)).orderBy("sort_key", *then)


def mapped_levels(df: DataFrame, column: str, mapping: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Collapse by a mapping table; unlisted levels stay.

    ``mapping`` has one row per old level.  Spark broadcasts it when its size
    allows and shuffles otherwise.
    """
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(m, df[column] == m["__old"], "left").select(
        *[F.coalesce(m["__new"], df[c]).alias(c) if c == column else df[c] for c in df.columns]
    )


def stacked(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A few fixed rows as part of the plan, so that Spark knows how small they are."""
    cells = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))
