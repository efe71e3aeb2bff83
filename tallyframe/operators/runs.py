"""Collating the result documents of many external runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.ordered import PIECE, TIE, in_pieces, numbered


def collate_runs(documents: DataFrame, model: str, fit: str, run: str) -> DataFrame:
    """Runs ranked by fit within their model, best first; ``run`` breaks ties."""
    order = [fit, run]
    ranked = numbered(in_pieces(documents, [model], order), [model], order, "rank")
    return ranked.drop(PIECE, TIE).orderBy(model, "rank")


def best_runs(documents: DataFrame, model: str, fit: str, run: str) -> DataFrame:
    """The best run of each model, whole."""
    rest = [c for c in documents.columns if c != model]
    best = documents.groupBy(model).agg(F.min_by(F.struct(*rest), F.struct(fit, run)).alias("__best"))
    return best.select(model, "__best.*")


def complete_configurations(df: DataFrame, marker: str) -> DataFrame:
    """Run configurations without header lines repeated in the middle of a file."""
    return df.filter(F.col(marker) != marker)
