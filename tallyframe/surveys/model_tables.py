"""Tables around the behavioural model: its target vectors, its fitted runs and the
types of agents they stand for.  The solver itself is not part of this library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.text import lenient_double
from tallyframe.operators import series
from tallyframe.operators.runs import complete_configurations
from tallyframe.sources import readers, writers

RUN_COLUMNS = ["beta_hyp", "beta_var", "L_", "phi", "k", "k0", "k1", "w_lo_k", "b0", "b1", "w_lo_beta", "d0", "d1", "w_lo_delta"]
FIT_COLUMNS = ["GOF", "GOF_cons", "GOF_search"]


def moment_vectors(documents: DataFrame, vectors: list[str]) -> DataFrame:
    """(series, position, value) from arrays in one JSON document; ``--`` is NULL."""
    cells = [
        documents.select(F.lit(v).alias("series"), F.posexplode(F.col(v)).alias("position", "text")) for v in vectors
    ]
    return reduce(DataFrame.unionByName, cells).select("series", "position", lenient_double(F.col("text")).alias("value"))


def target_window(
    vectors: DataFrame, values: str, errors: str, start: int, length: int, errors_start: int = 0, normalise_at: int | None = None
) -> DataFrame:
    """``length`` targets of one vector from 0-based ``start`` with their standard
    errors, over the value at ``normalise_at`` when given."""
    value = vectors.filter(F.col("series") == values)
    if normalise_at is not None:
        value = series.rebased(value, ["series"], "position", "value", F.lit(normalise_at), "value")
    se = vectors.filter(F.col("series") == errors).select(
        (F.col("position") - errors_start).alias("period"), F.col("value").alias("se")
    )
    cut = value.filter((F.col("position") >= start) & (F.col("position") < start + length))
    return cut.select("series", (F.col("position") - start).alias("period"), "value").join(se, "period", "left")


def read_fitted_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per named run of a result document ``{run: {parameter: value}}``."""
    document = spark.read.text(path, wholetext=True)
    runs = document.select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("run", "parameters"))

    def number(name: str) -> Column:
        return lenient_double(F.try_element_at("parameters", F.lit(name))).alias(name)

    return runs.select(
        "run",
        F.try_element_at("parameters", F.lit("opt_type")).alias("opt_type"),
        *[number(c) for c in [*RUN_COLUMNS, *FIT_COLUMNS]],
    )


def agent_types(runs: DataFrame) -> DataFrame:
    """Types of agents of each run with their starting share.

    Runs differ in what varies: nothing, the search cost ``k``, or ``k`` together
    with short-run (``b``) or long-run (``d``) patience.
    """
    return series.type_mixture(
        runs,
        ["run", "opt_type", "phi", "L_", *FIT_COLUMNS],
        {
            "k": (F.coalesce("k0", "k"), F.col("k1"), F.col("w_lo_k")),
            "beta": (F.coalesce("b0", "beta_hyp", F.lit(1.0)), F.col("b1"), F.col("w_lo_beta")),
            "delta": (F.coalesce("d0", "beta_var"), F.col("d1"), F.col("w_lo_delta")),
        },
    ).withColumnRenamed("weight", "init_share")


def fit_log(types: DataFrame) -> DataFrame:
    """Run by type with fit and parameters, best run first."""
    return types.select(
        "run", "type", "init_share", F.col("GOF_cons").alias("cons_GOF"), F.col("GOF_search").alias("search_GOF"),
        "beta", "delta", "L_", "k", F.col("phi").alias("xi"), "GOF",
    ).orderBy("GOF", "run", "type")


def configuration_documents(spark: SparkSession, path: str, columns: list[str], out: str) -> None:
    """One JSON document per row of a run configuration file with the given columns."""
    text = readers.read_csv(spark, path, ", ".join(f"`{c}` string" for c in columns))
    rows = complete_configurations(text, "opt_type")
    typed = rows.select(*[F.col(c) if c == "opt_type" else lenient_double(F.col(c)).alias(c) for c in columns])
    writers.write_json(typed, out, one_per_file=True)


def states_of_environment(documents: DataFrame) -> DataFrame:
    """(state, pay) from the income vector of an environment document."""
    return documents.select(F.posexplode("z_vals").alias("state", "pay"))


def transitions_of_environment(documents: DataFrame) -> DataFrame:
    """(from_state, to_state, p) from its transition matrix; rows sum to 1."""
    return readers.matrix_to_long(documents, [], "Pi")
