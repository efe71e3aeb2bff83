"""Where intermediate tables go.

Some operators need one physical assignment of rows to pieces that stays the
same however often it is read, also after an executor is lost.  They write that
table once to a shared folder and read it back, which also cuts the lineage.
The files have to outlive the DataFrames that read them.  ``owned`` deletes those made
inside a ``with`` block at its end, for results that are used within it; ``clear`` deletes
all of this process.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_dir: str | None = None
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a temporary folder: on a
    cluster a machine-local folder would be invisible to the other executors.
    """
    global _local_dir
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_dir


def new_path(spark: SparkSession, label: str) -> str:
    _made.append(f"{shared_dir(spark)}/tallyframe/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def delete(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made:
        _made.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; DataFrames that read them end with it."""
    for path in list(_made):
        delete(spark, path)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside the block at its end, also after an error."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before]:
            delete(spark, path)


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
