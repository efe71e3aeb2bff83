import random

import duckdb
import pytest
from conftest_llm import collected
from pyspark.sql import functions as F

from tallyframe.llm import vectors as V
from tallyframe.llm.tables import read

SCHEMA = "vec_id long, embedding array<double>, v int, n int"


def by_sql(vectors):
    embeddings = vectors.select("vec_id", "embedding").toArrow()  # noqa: F841  read by the query
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    return con.execute(V.OP10_SQL).fetchall()


def found(vectors):
    return collected(V.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors))


def test_against_sql(spark):
    for folder in ("sf0.001", "sf0.01"):
        vectors = read(spark, f"/root/testdata/{folder}", "embeddings")
        assert sorted(found(vectors)) == sorted(by_sql(vectors))


def test_ties_copies_and_odd_rows(spark):
    rows = [(i, [0.1, -0.2, 0.3], 0, 0) for i in range(40, 120)] + [(i, [i / 100, -i / 50, 0.01], 0, 0) for i in range(200, 260)]
    rows += [(None, [1.0, 1.0, 1.0], 0, 0), (1, None, 0, 0), (2, [None, 1.0, 2.0], 0, 0), (3, [float("nan"), 1.0, 1.0], 0, 0)]
    rows += [(4, [float("-inf"), 1.0, 1.0], 0, 0), (300, [0.5, 0.5], 0, 0), (301, [0.25, 0.5], 0, 0), (350, [], 0, 0), (351, [], 0, 0)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(found(vectors)) == sorted(by_sql(vectors))
    assert found(vectors.filter("vec_id = 300")) == []
    assert found(vectors.filter("vec_id is null")) == [] and found(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("size", [7, 64])
def test_many_small_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(V, "BLOCK", size)
    monkeypatch.setattr(V, "QUERY_BLOCK", 5)
    vectors = read(spark, "/root/testdata/sf0.001", "embeddings")
    assert sorted(found(vectors)) == sorted(by_sql(vectors))


def test_rows_that_repeat_a_query_leave_room_for_equal_vectors(spark):
    rows = [(50, [0.9, 0.8], 0, 0)] * 12 + [(51, [0.9, 0.8], 0, 0)] + [(52, [0.9, 0.8], 0, 0)] * 9 + [(i, [0.1, 0.2], 0, 0) for i in range(60, 70)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted({r for r in found(vectors) if r[0] == 50})
    assert [r[2] for r in got] == [51, 52, 52, 52, 52]
    others = vectors.filter("vec_id <> 50").union(vectors.filter("vec_id = 50").limit(1))
    assert got == sorted(r for r in by_sql(others) if r[0] == 50)


def test_scores_beyond_exact_floats(spark):
    """Scores up to 8e18, many of them apart by less than a double can tell."""
    rng = random.Random(8)
    base = [rng.randint(650_000_000, 700_000_000) for _ in range(16)]
    vectors = [[b + rng.choice([0, 0, 0, 1, -1]) for b in base] for _ in range(400)]
    vectors += [[-b for b in base], [0] * 16, [rng.randint(-(10**8), 10**8) for _ in range(16)]]
    rows = [(i, [v / 256 for v in x], 0, 0) for i, x in enumerate(vectors)]
    got = sorted(found(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    want = []
    for q in range(0, len(vectors), 50):
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], x)), i) for i, x in enumerate(vectors) if i != q)
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:5])]
    assert got == sorted(want) and max(r[3] for r in got) > 7e18


def test_scores_that_do_not_fit_are_an_error(spark):
    rows = [(50, [8.3e6] * 16, 0, 0), (51, [1.0] * 16, 0, 0)]
    with pytest.raises(ValueError, match="64 bits"):
        found(spark.createDataFrame(rows, SCHEMA))
