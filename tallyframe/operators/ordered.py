"""Order-dependent work inside groups of any size.

``in_pieces`` cuts a table by range over (group, order) and writes it once to the
shared folder, so that a group of any size becomes a run of numbered pieces, each
about one partition large.  The other functions do the ordered work inside a piece
and carry one summary row per piece over to the next ones.  For tables whose
groups are small by construction (one row per entity and period) a plain window
is the better choice, and the panel operators use that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.attach import same_key
from tallyframe.session import materialise

PIECE, TIE = "__piece", "__tie"


def in_pieces(df: DataFrame, keys: list[str], order: list[str], pieces: int | None = None) -> DataFrame:
    """``df`` with a piece number that rises with (keys, order).

    The range cut comes from Spark's own sampling, so it follows the data: a hot
    group gets many pieces, and many small groups share one.  Without ``pieces``
    there are up to ``spark.sql.shuffle.partitions``, fewer when adaptive execution
    finds them small.  Rows equal in (keys, order) follow one another by a hash of all
    their columns (``TIE``), so every run orders them alike; rows equal in all columns
    are interchangeable.  The table is written before use because a second evaluation
    could cut elsewhere.
    """
    by = [*keys, *order, TIE]
    df = df.withColumn(TIE, F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind]))
    cut = df.repartitionByRange(*by) if pieces is None else df.repartitionByRange(pieces, *by)
    return materialise(cut.withColumn(PIECE, F.spark_partition_id()), "pieces")


def _with_tie(df: DataFrame, order: list[str]) -> list[str]:
    return [*order, TIE] if TIE in df.columns else order


def _join_piece(df: DataFrame, summary: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    right = summary.select(*[F.col(c).alias(f"__s_{c}") for c in [*keys, PIECE]], *names)
    on = same_key([df[c] for c in [*keys, PIECE]], [right[f"__s_{c}"] for c in [*keys, PIECE]])
    return df.join(right, on, "left").select(*[df[c] for c in df.columns], *[right[n] for n in names])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based row number of each row in its group; ``df`` comes from in_pieces."""
    before = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, PIECE).agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, PIECE).orderBy(*_with_tie(df, order))
    local = df.withColumn("__local", F.row_number().over(inside))
    return (
        _join_piece(local, offsets, keys, ["__offset"])
        .withColumn(name, (F.col("__local") + F.col("__offset")).cast("long"))
        .drop("__local", "__offset")
    )


def lagged(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The value on the previous row of the group; ``df`` comes from in_pieces."""
    order = _with_tie(df, order)
    last = df.groupBy(*keys, PIECE).agg(F.max_by(F.struct(value), F.struct(*order)).alias("__last"))
    carried = last.withColumn(
        "__carried", F.lag("__last").over(Window.partitionBy(*keys).orderBy(PIECE))
    )
    inside = Window.partitionBy(*keys, PIECE).orderBy(*order)
    local = df.withColumn("__local", F.lag(F.struct(value)).over(inside))
    return (
        _join_piece(local, carried, keys, ["__carried"])
        .withColumn(name, F.coalesce("__local", "__carried")[value])
        .drop("__local", "__carried")
    )
