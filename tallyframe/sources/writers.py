"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, in folders by e.g. wave so later reads prune."""
    df.write.parquet(path, partitionBy=partition_by)


def write_json(df: DataFrame, path: str, one_per_file: bool = False) -> None:
    """One JSON document per row; NULL fields stay as explicit nulls."""
    writer = json_rows(df).write
    (writer.option("maxRecordsPerFile", 1) if one_per_file else writer).text(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
