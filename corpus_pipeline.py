"""From raw documents to packed training sequences.

Every stage but the last takes and returns the columns of ``documents``; what a stage
returns is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.chosen_path import near_duplicate_stage
from tallyframe.llm.language import language_stage
from tallyframe.llm.lines import line_stage
from tallyframe.llm.mixing import mixing_stage
from tallyframe.llm.packing import packing_stage
from tallyframe.llm.tables import read
from tallyframe.session import delete, new_path, owned

#: Language identification drops texts of no known language; line dedup drops repeated
#: lines; the n-gram join keeps one document of each class; mixing takes every document as
#: often as its source's target asks; packing returns the pieces of all sequences.
STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: A trained network has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what earlier stages wrote is deleted as soon as the next one is done."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"llm-stage-{name}")
        with owned(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
