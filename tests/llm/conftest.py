import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent)]

from conftest_llm import edge_rows, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, names that operators use."""
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
