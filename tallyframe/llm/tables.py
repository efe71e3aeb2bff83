"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import materialise

ROW = "row"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder: one evaluation, and no lineage to lose."""
    return materialise(df, f"llm-{label}")


def whole_text(column: str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``row`` beside ``columns``, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    return df.select(*[replaced[n].alias(n) if n in replaced else F.col(f"{ROW}.`{n}`") for n in names])


def cells_of(rows: pa.StructArray, place: int, size: int = 512) -> Iterator:
    """One column of packed rows as Python values, a few of them at a time."""
    column = rows.field(place)
    for start in range(0, len(column), size):
        yield from column.slice(start, size).to_pylist()


def with_cells(rows: pa.StructArray, place: int, column: pa.Array) -> pa.StructArray:
    """Packed rows with one column replaced."""
    columns = [column if i == place else rows.field(i) for i in range(rows.type.num_fields)]
    return pa.StructArray.from_arrays(columns, fields=list(rows.type))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples; only one batch is held as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield from zip(*[part.column(n).to_pylist() for n in names])


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, weight: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows and about ``weight`` bytes of text."""
    held, heavy = [], 0
    for row in rows:
        held.append(row)
        heavy += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= size or heavy >= weight:
            yield _batch(held, schema)
            held, heavy = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
