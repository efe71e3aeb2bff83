"""Group aggregates on every row, safe when one group holds most of the rows.

A window over the group would bring the whole group into one task.  Here the
aggregate is computed with map-side combine, written (one row per group) and joined
back.  Where no group is hot this is a plain join, which Spark broadcasts by the size
of the written table.  Otherwise rows of a hot group are spread over several join
partitions, each with its own copy of the one aggregate row.  Nothing is dropped, and
cold groups pay nothing for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialise

HOT_ROWS = 1_000_000
MOST_HOT_GROUPS = 100_000


def same_key(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of all keys, so a NULL key is a group as in groupBy."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def attach(
    df: DataFrame,
    keys: list[str],
    aggregates: list[Column],
    spread: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``df`` plus the named ``aggregates`` of each row's group.

    ``spread`` names columns that tell rows of one group apart (a row id); the
    default is all columns.  Rows equal in all of them stay together, so name an id
    where whole rows repeat.  The only broadcast is the list of hot groups.  A group
    is hot when it has more than ``hot_rows`` rows and more than its part of
    MOST_HOT_GROUPS equal parts of the table, so the list never has more than
    MOST_HOT_GROUPS rows however large the table is.  ``df`` is read twice, with few
    columns for the first time; write it first when it is costly to compute.
    """
    renamed = [f"__key_{k}" for k in keys]
    groups = df.groupBy(*keys).agg(*aggregates, F.count(F.lit(1)).alias("__rows"))
    names = [c for c in groups.columns if c not in keys and c != "__rows"]
    groups = materialise(groups.select(*[F.col(k).alias(r) for k, r in zip(keys, renamed)], *names, "__rows"), "groups")
    sizes = groups.agg(F.sum("__rows").alias("whole"), F.max("__rows").alias("most")).first()
    share_rows = max(hot_rows, (sizes["whole"] or 0) / MOST_HOT_GROUPS)
    if (sizes["most"] or 0) <= share_rows:
        matched = same_key([F.col(k) for k in keys], [F.col(r) for r in renamed])
        return df.join(groups, matched, "inner").select(*df.columns, *names)
    groups = groups.withColumn("__shares", F.ceil(F.col("__rows") / share_rows).cast("int"))
    hot = groups.filter("__shares > 1").select(*[F.col(r).alias(f"__hot{r}") for r in renamed], "__shares")
    share = F.pmod(F.xxhash64(*(spread or df.columns)), F.coalesce("__shares", F.lit(1))).cast("int")
    rows = df.join(
        F.broadcast(hot), same_key([F.col(k) for k in keys], [F.col(f"__hot{r}") for r in renamed]), "left"
    ).select(*[F.col(c) for c in df.columns], share.alias("__share"))
    copies = groups.select(
        *renamed, *names, F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)).alias("__copy")
    )
    matched = same_key([F.col(k) for k in keys], [F.col(r) for r in renamed]) & (F.col("__share") == F.col("__copy"))
    return rows.join(copies, matched, "inner").select(*df.columns, *names)


def keep_groups(
    df: DataFrame,
    keys: list[str],
    condition: Column,
    spread: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All rows of the groups whose aggregate ``condition`` is true."""
    kept = attach(df, keys, [condition.alias("__keep")], spread, hot_rows)
    return kept.filter("__keep").drop("__keep")


def rows_at_max(df: DataFrame, keys: list[str], value: str, spread: list[str] | None = None) -> DataFrame:
    """Rows that reach their group's maximum; ties are all kept."""
    marked = attach(df, keys, [F.max(value).alias("__max")], spread)
    return marked.filter(F.col(value) == F.col("__max")).drop("__max")


def rows_like_first(
    df: DataFrame, keys: list[str], value: str, order: list[str], spread: list[str] | None = None
) -> DataFrame:
    """Rows whose value equals the value on the group's first row."""
    first = F.min_by(value, F.struct(*order)).alias("__first")
    marked = attach(df, keys, [first], spread)
    return marked.filter(F.col(value) == F.col("__first")).drop("__first")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the first in explicit order."""
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return chosen.select(*[F.col(k) if k in keys else F.col("__row")[k].alias(k) for k in df.columns])
