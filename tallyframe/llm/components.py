"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.tables import written

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(key, label) for every end of ``edges`` (a, b); a component's label is its smallest key.

    A round takes the smallest label among neighbours and then the label of that label,
    so chains shorten geometrically.  Labels of a round are written to the shared folder.

    Repeated edges count once; loops and edges with a null end connect nothing and name no
    key; an empty table gives no rows; other columns are ignored.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    for _ in range(MOST_ROUNDS):
        beside = both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(beside, labels["key"] == beside["a"]).select("key", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("key").alias("up"), F.col("label").alias("higher"))
        jumped = lower.join(up, lower["low"] == up["up"]).select("key", F.least("low", "higher").alias("label"), F.col("label").alias("was"))
        jumped = written(jumped, "labels")
        labels = jumped.select("key", "label")
        if jumped.filter("label <> was").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {MOST_ROUNDS} rounds")
