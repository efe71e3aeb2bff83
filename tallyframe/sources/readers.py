"""Reading survey files: CSV with quirks, wave files, JSON parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.ordered import PIECE, TIE, in_pieces, numbered


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, null_text: str | None = None) -> DataFrame:
    """CSV with one header row.  Quotes, a byte order mark and CR or CRLF line
    ends are Spark's own work; ``null_text`` reads as NULL."""
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    if null_text is not None:
        reader = reader.option("nullValue", null_text)
    return reader.csv(path)


def null_tokens(df: DataFrame, *tokens: str) -> DataFrame:
    """Turn every text cell that equals one of the tokens into NULL."""
    return df.select(
        *[
            F.when(~F.col(f.name).isin(*tokens), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_csv_without_preamble(
    spark: SparkSession, path: str, columns: list[str], header: str, keep: Column | None = None
) -> DataFrame:
    """CSV with title lines above its header.

    All cells are read as text under the given names; a row is data when it is
    neither the header (its first cell says ``header``) nor refused by ``keep``,
    which should tell title and footer rows apart by content.  Nothing depends on
    the position in the file, so the read splits as any other.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).csv(path)
    rows = raw.filter(F.coalesce(F.col(columns[0]) != header, F.lit(True)))
    return rows if keep is None else rows.filter(keep)


def line_range(df: DataFrame, source: str, order: str, skip: int = 0, rows: int | None = None) -> DataFrame:
    """Rows ``skip + 1`` to ``skip + rows`` of every source in explicit order."""
    out = numbered(in_pieces(df, [source], [order]), [source], [order], "line").drop(PIECE, TIE)
    out = out.filter(F.col("line") > skip)
    return out if rows is None else out.filter(F.col("line") <= skip + rows)


def read_waves(spark: SparkSession, pattern: str, wave: str = "wave", number: str = r"wave(\d+)") -> DataFrame:
    """All wave files in one scan, the wave number taken from each file's path."""
    df = spark.read.parquet(pattern)
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, number, 1).cast("int").alias(wave))


def without_metadata(df: DataFrame) -> DataFrame:
    """Drop the labels that statistical file formats leave on columns."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={}) for c in df.columns])


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON parameter documents, one row each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def matrix_to_long(df: DataFrame, keys: list[str], matrix: str) -> DataFrame:
    """``array<array<double>>`` to rows of (from_state, to_state, p)."""
    rows = df.select(*keys, F.posexplode(matrix).alias("from_state", "row"))
    return rows.select(*keys, "from_state", F.posexplode("row").alias("to_state", "p"))


def read_result_documents(spark: SparkSession, folder: str, prefix: str, schema: T.StructType | str) -> DataFrame:
    """Every result document in a folder whose file name starts with ``prefix``."""
    return spark.read.schema(schema).json(f"{folder}/{prefix}*")
