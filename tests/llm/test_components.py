import random

from conftest_llm import collected

from tallyframe.llm.components import components


def by_hand(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            root[max(top(a), top(b))] = min(top(a), top(b))
    return sorted((x, top(x)) for x in root)


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 300)]
    rng.shuffle(chain)
    star = [(1000, 1001 + i) for i in range(50)] + [(1001, 1000)] * 5
    loose = [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)]
    edges = chain + star + loose
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in edges], "a long, b long, key string, label int").repartition(5)
    assert sorted(collected(components(frame))) == by_hand(edges)


def test_null_ends_loops_and_empty_tables(spark):
    edges = [(1, None), (None, 2), (None, None), (3, 3), (4, 5), (5, 4), (4, 5), (5, 6)]
    frame = spark.createDataFrame(edges, "a long, b long")
    assert sorted(collected(components(frame))) == [(4, 4), (5, 4), (6, 4)]
    assert collected(components(frame.limit(0))) == [] and collected(components(frame.filter("a = 3"))) == []
