"""Operators with one group holding at least a third of all rows, cut into many
pieces, against plain Python on the same rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.attach import attach, first_rows, keep_groups, rows_at_max, rows_like_first
from tallyframe.operators.ordered import PIECE, in_pieces, lagged, numbered
from tallyframe.operators.weights import scale_cell, weighted_quantiles

ROWS = 3000


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for i in range(ROWS):
        key = "hot" if rnd.random() < 0.4 else None if rnd.random() < 0.05 else f"k{rnd.randrange(40)}"
        value = 0.0 if rnd.random() < 0.35 else round(rnd.uniform(-50, 50), 2)
        out.append((i, key, value, float(rnd.randrange(1, 5))))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, value double, w double").repartition(6)


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[1]].append(r)
    return out


def test_attach_spreads_hot_groups_and_keeps_null_keys(df, rows):
    out = attach(df, ["key"], [F.sum("w").alias("total"), F.count("*").alias("n")], spread=["id"], hot_rows=50)
    want = {k: (sum(r[3] for r in g), len(g)) for k, g in groups(rows).items()}
    got = out.collect()
    assert len(got) == ROWS and len({r.id for r in got}) == ROWS
    assert all((r.total, r.n) == want[r.key] for r in got)


def test_attach_with_duplicate_rows(spark):
    copies = spark.createDataFrame([("a", 1.0)] * 500 + [("b", 2.0)] * 3, "key string, v double")
    out = attach(copies, ["key"], [F.count("*").alias("n")], hot_rows=20)
    assert sorted(r.n for r in out.collect()) == [3] * 3 + [500] * 500


def test_hot_groups_share_partitions(spark, df):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = attach(df, ["key"], [F.count("*").alias("n")], spread=["id"], hot_rows=50)
        sizes = [r["count"] for r in out.filter("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 4 and max(sizes) < ROWS * 0.25
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keep_max_and_first(df, rows):
    by = groups(rows)
    kept = {r.id for r in keep_groups(df, ["key"], F.count("*") > 40, spread=["id"], hot_rows=50).collect()}
    assert kept == {r[0] for g in by.values() if len(g) > 40 for r in g}
    top = {r.id for r in rows_at_max(df, ["key"], "w", spread=["id"]).collect()}
    assert top == {r[0] for g in by.values() for r in g if r[3] == max(x[3] for x in g)}
    like = {r.id for r in rows_like_first(df, ["key"], "w", ["id"], spread=["id"]).collect()}
    assert like == {r[0] for g in by.values() for r in g if r[3] == min(g)[3]}
    assert {r.id for r in first_rows(df, ["key"], ["id"]).collect()} == {min(g)[0] for g in by.values()}


@pytest.mark.parametrize("pieces", [1, 7, 40])
def test_numbers_and_lags_cross_pieces(df, rows, pieces):
    cut = in_pieces(df, ["key"], ["id"], pieces)
    if pieces > 1:
        assert cut.filter("key = 'hot'").select(PIECE).distinct().count() > 1
    out = lagged(numbered(cut, ["key"], ["id"], "n"), ["key"], ["id"], "value", "prior").collect()
    assert len(out) == ROWS
    for key, group in groups(rows).items():
        got = sorted((r.id, r.n, r.prior) for r in out if r.key == key)
        ordered = sorted(group)
        assert got == [(r[0], i + 1, ordered[i - 1][2] if i else None) for i, r in enumerate(ordered)]


def test_lag_keeps_null_values(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (4, "q")], "t int, v string").withColumn("g", F.lit("g"))
    cut = in_pieces(rows, ["g"], ["t"], 4)
    assert [r.p for r in lagged(cut, ["g"], ["t"], "v", "p").orderBy("t").collect()] == [None, "x", None, "z"]


def quantile(pairs, q):
    total, running = sum(w for _, w in pairs), 0.0
    for x, w in sorted(pairs):
        running += w
        if running >= q * total:
            return x


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_weighted_quantiles_of_a_hot_group(spark, df, rows, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
        got = weighted_quantiles(df, ["key"], "value", "w", probs).collect()
        by = groups(rows)
        assert len(got) == len(by)
        for r in got:
            pairs = [(x[2], x[3]) for x in by[r.key]]
            assert [r[p] for p in probs] == [quantile(pairs, q) for q in probs.values()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_smallest_value_and_groups_without_weight(spark):
    rows = [("a", 3.0, 1.0), ("a", -2.0, 2.0), ("a", 7.5, 1.0), ("b", 1.0, 0.0), ("c", None, 4.0), (None, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, w double")
    out = weighted_quantiles(df, ["k"], "x", "w", {"least": 0.0, "half": 0.5, "most": 1.0}).collect()
    assert {r.k: (r.least, r.half, r.most) for r in out} == {
        "a": (-2.0, -2.0, 7.5), "b": (None,) * 3, "c": (None,) * 3, None: (5.0,) * 3,
    }
    linear = weighted_quantiles(df.filter("w > 0"), ["k"], "x", None, {"least": 0.0, "half": 0.5}, interpolate=True).collect()
    assert {r.k: (r.least, r.half) for r in linear}["a"] == (-2.0, 3.0)


def test_ranks_are_exact_where_a_float_target_is_not(spark):
    # 0.1 * 30 is above 3 in floating point
    df = spark.createDataFrame([(float(i),) for i in range(1, 31)], "x double")
    assert weighted_quantiles(df, [], "x", None, {"p10": 0.1}).first()["p10"] == 3.0


def test_cells_rise_with_values(spark):
    values = [float("-inf"), -1e300, -5.0, -4.99, -1e-300, -0.0, 0.0, 5e-324, 1e-9, 0.5, 1.0, 1.01, 3e7, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    cells = [r.c for r in df.select("i", scale_cell(F.col("x")).alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells)


def test_linear_percentiles_equal_numpy(df, rows):
    import numpy as np

    got = weighted_quantiles(df, ["key"], "value", None, {"a": 0.25, "b": 0.5, "c": 0.99}, interpolate=True).collect()
    by = groups(rows)
    for r in got:
        assert [r.a, r.b, r.c] == pytest.approx(list(np.percentile([x[2] for x in by[r.key]], [25, 50, 99])))


def test_quantiles_without_groups_and_with_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (3.0, 1.0), (9.0, None)], "x double, w double")
    assert weighted_quantiles(df, [], "x", "w", {"m": 0.5, "t": 0.9}).collect() == [(1.0, 3.0)]
    one = spark.createDataFrame([(4.0,)], "x double")
    assert weighted_quantiles(one, [], "x", None, {"m": 0.5}, interpolate=True).collect() == [(4.0,)]


@pytest.mark.parametrize("scale", [1e-9, 1e-7, 3e-300, 1.0, 1e15, 1e250])
def test_weights_of_any_size(spark, scale):
    rows = [("a", float(i), scale * (1 + i % 5)) for i in range(1, 101)] + [("b", 1.0, scale), ("b", 2.0, scale * 1e-6)]
    df = spark.createDataFrame(rows, "k string, x double, w double")
    got = {r.k: (r.p, r.m) for r in weighted_quantiles(df, ["k"], "x", "w", {"p": 0.25, "m": 1.0}).collect()}
    assert got == {"a": (25.0, 100.0), "b": (1.0, 2.0)}


def test_weights_that_fit_no_common_unit_are_an_error(spark):
    df = spark.createDataFrame([(1.0, 1e-30), (2.0, 1.0)], "x double, w double")
    with pytest.raises(ValueError, match="do not fit"):
        weighted_quantiles(df, [], "x", "w", {"m": 0.5})


def test_a_cell_of_many_values_is_cut_finer(spark, monkeypatch):
    from tallyframe.operators import weights

    sizes = []
    finer = weights._finer

    def seen(inside, holds, heavy, names, by):
        out = finer(inside, holds, heavy, names, by)
        sizes.append((inside.groupBy("k", "__at").count().agg(F.max("count")).first()[0], out[0].groupBy("k", "__at").count().agg(F.max("count")).first()[0]))
        return out

    monkeypatch.setattr(weights, "HEAVY", 20)
    monkeypatch.setattr(weights, "FINER", 8)
    monkeypatch.setattr(weights, "_finer", seen)
    rows = [(k, 1.7e9 + i * i, float(1 + i % 3)) for i in range(1000) for k in ("a", None)] + [("b", 5.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, w double")
    probs = {"least": 0.0, "p10": 0.1, "p50": 0.5, "most": 1.0}
    got = weighted_quantiles(df, ["k"], "x", "w", probs).collect()
    pairs = [(x, w) for k, x, w in rows if k == "a"]
    want = tuple(quantile(pairs, q) for q in probs.values())
    assert {r.k: tuple(r)[1:] for r in got} == {"a": want, None: want, "b": (5.0,) * 4}
    assert len(sizes) > 1 and sizes[-1][1] <= 20 < sizes[0][0]


def test_weights_of_many_powers_of_ten_in_one_cell(spark, monkeypatch):
    """Sums of each power are brought to one unit; also where cells are written and cut."""
    from decimal import Decimal

    from tallyframe.operators import weights

    rng = random.Random(11)
    rows = [("ab"[i % 2], 1000.0 + rng.randint(0, 400) / 1000, rng.choice([1e-9, 0.003, 0.1, 7.25, 12345.678, 9.9e6])) for i in range(1500)]
    rows += [("a", 5.0, 0.0), ("b", 1000.0, float("nan")), ("b", 1000.0, float("inf"))]
    df = spark.createDataFrame(rows, "k string, x double, w double").repartition(4)
    probs = {"least": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "most": 1.0}
    want = {}
    for key in "ab":
        pairs = sorted((x, Decimal(repr(w))) for k, x, w in rows if k == key and w < float("inf"))
        total, running, found = sum(w for _, w in pairs), Decimal(0), {}
        for x, w in pairs:
            running += w
            found |= {n: found.get(n, x) for n, q in probs.items() if running >= Decimal(repr(q)) * total}
        want[key] = tuple(found[n] for n in probs)
    for heavy in (weights.HEAVY, 20):
        monkeypatch.setattr(weights, "HEAVY", heavy)
        got = weighted_quantiles(df, ["k"], "x", "w", probs).collect()
        assert {r.k: tuple(r)[1:] for r in got} == want


def test_means_come_with_the_quantiles(spark):
    rows = [("a", 1.0, 2.0, 4.0), ("a", None, 1.0, 1.0), ("a", 3.0, 1.0, None), ("b", None, 2.0, None), (None, 8.0, 1.5, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, w double, y double")
    means = {"x_mean": (F.col("x"), F.col("w")), "y_mean": (F.col("y"), F.col("w"))}
    got = weighted_quantiles(df, ["k"], "x", "w", {"half": 0.5}, means=means).collect()
    assert {r.k: (r.half, r.x_mean, r.y_mean) for r in got} == {
        "a": (1.0, 5 / 3, 3.0), "b": (None, None, None), None: (8.0, 8.0, 2.0),
    }


def test_small_quantiles_write_one_table(spark, monkeypatch):
    from tallyframe.operators import weights

    written = []
    kept = weights.materialise
    monkeypatch.setattr(weights, "materialise", lambda df, label: written.append(label) or kept(df, label))
    df = spark.createDataFrame([(float(i), 0.5 + i) for i in range(50)], "x double, w double")
    assert weighted_quantiles(df, [], "x", "w", {"m": 0.5}).first()["m"] == 35.0
    assert written == ["cells"]


def test_rows_of_equal_order_follow_one_another_alike_in_every_run(spark):
    rows = [("g", i % 5, f"v{i:03d}") for i in range(300)] + [("g", 2, "v000")] * 3 + [(None, None, None)] * 2
    df = spark.createDataFrame(rows, "g string, t int, v string")
    seen = []
    for parts, pieces in ((1, 1), (7, 4), (3, 9)):
        cut = in_pieces(df.repartition(parts), ["g"], ["t"], pieces)
        out = lagged(numbered(cut, ["g"], ["t"], "n"), ["g"], ["t"], "v", "before")
        seen.append(sorted((r.g is None, r.n, r.t, r.v, r.before) for r in out.collect()))
    assert seen[0] == seen[1] == seen[2]
    assert [n for gone, n, *_ in seen[0] if not gone] == list(range(1, 304))
