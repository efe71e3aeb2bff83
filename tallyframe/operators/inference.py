"""Gradients of moments and the matrices behind standard errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 528 sums in one aggregate.
MOST_PARAMETERS = 32


def central_difference(runs: DataFrame, keys: list[str], side: str, value: str, step: float) -> DataFrame:
    """(plus - minus) / (2 step) per key from the two perturbed runs."""
    at = {s: F.max(F.when(F.col(side) == s, F.col(value))) for s in ("minus", "plus")}
    return runs.groupBy(*keys).agg(((at["plus"] - at["minus"]) / (2 * step)).alias("partial"))


def weighted_gram(
    gradients: DataFrame, moment: str, parameter: str, parameters: list[str], weights: DataFrame, weight: str
) -> DataFrame:
    """Sum over moments of w g_i g_j for every ordered pair of parameters.

    The named parameters become columns of one row per moment, so all pairs are
    sums of one pass and no pair of rows is ever joined.  One aggregate holds k(k + 1)/2
    sums, so k is at most ``MOST_PARAMETERS``; more is an error.
    """
    if len(parameters) > MOST_PARAMETERS:
        raise ValueError(f"{len(parameters)} parameters; one pass takes at most {MOST_PARAMETERS}")
    row = gradients.groupBy(moment).pivot(parameter, parameters).agg(F.max("partial"))
    row = row.join(weights.select(moment, F.col(weight).alias("__w")), moment)
    n = range(len(parameters))
    sums = row.agg(
        *[
            F.sum(F.col("__w") * F.col(f"`{parameters[i]}`") * F.col(f"`{parameters[j]}`")).alias(f"g{i}_{j}")
            for i in n
            for j in n
            if i <= j
        ]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(parameters[i]).alias("param_i"),
                F.lit(parameters[j]).alias("param_j"),
                F.col(f"g{min(i, j)}_{max(i, j)}").alias("value"),
            )
            for i in n
            for j in n
        ]
    )
    return sums.select(F.inline(cells))


def parameter_variances(
    bread: DataFrame, meat: DataFrame, parameters: list[str], divide_by_count: bool = False
) -> np.ndarray:
    """The k x k sandwich inverse(bread) meat inverse(bread) from two gram tables.

    Only the k squared summed cells (k is the number of parameters) reach the
    driver.  ``divide_by_count`` divides by k once more.
    """
    place = {p: i for i, p in enumerate(parameters)}

    def matrix(table: DataFrame) -> np.ndarray:
        out = np.zeros((len(parameters), len(parameters)))
        for r in table.collect():
            out[place[r["param_i"]], place[r["param_j"]]] = r["value"]
        return out

    inverse = np.linalg.inv(matrix(bread))
    variances = inverse @ matrix(meat) @ inverse
    return variances / len(parameters) if divide_by_count else variances
