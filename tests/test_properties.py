"""Properties that hold for any data, on generated tables."""

import random
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import history, series, weights
from tallyframe.session import CHECKPOINT_CONF, clear, materialise, shared_dir


def table(spark, seed, n=400):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abc"), rnd.gauss(0, 1000), rnd.uniform(0.1, 3), rnd.randrange(12), rnd.randrange(4)) for _ in range(n)]
    return spark.createDataFrame(rows, "g string, x double, w double, t int, state int")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shares_sum_to_one(spark, seed):
    df = table(spark, seed)
    parts = weights.binned_distribution(df, "x", "w", 250, top=1500, bottom=-1500)
    assert parts.agg(F.sum("share")).first()[0] == pytest.approx(1)
    both = weights.multi_distribution([(df, "w", {"x": F.floor(F.col("x") / 100), "t": F.col("t").cast("bigint")})])
    assert tuple(both.agg(F.sum("pct_x"), F.sum("pct_t")).first()) == pytest.approx((1, 1))
    occupied = history.state_counts(df, ["g"], "state").groupBy("g").agg(F.sum("share").alias("s"))
    assert [r.s for r in occupied.collect()] == pytest.approx([1, 1, 1])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_weights_give_the_plain_quantile(spark, seed):
    df = table(spark, seed).withColumn("one", F.lit(0.7))
    probs = {"a": 0.1, "b": 0.37, "c": 0.5, "d": 0.9}
    got = {r.g: tuple(r)[1:] for r in weights.weighted_quantiles(df, ["g"], "x", "one", probs).collect()}
    plain = df.groupBy("g").agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY x)") for q in probs.values()])
    assert got == {r.g: tuple(r)[1:] for r in plain.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_do_not_depend_on_the_layout(spark, seed):
    df = table(spark, seed)
    first = sorted(map(tuple, weights.weighted_quantiles(df, ["g"], "x", "w", {"p": 0.5}).collect()))
    again = sorted(map(tuple, weights.weighted_quantiles(df.repartition(13, "t"), ["g"], "x", "w", {"p": 0.5}).collect()))
    assert first == again


@pytest.mark.parametrize("base", [0, 5, 11])
def test_chained_growth_returns_the_rebased_level(spark, base):
    rnd = random.Random(base)
    levels = spark.createDataFrame([("s", t, rnd.uniform(0.5, 2)) for t in range(12)], "s string, t int, v double")
    grown = levels.withColumn("g", series.pct_change(F.col("v"), series.over_time(["s"], "t")))
    chained = series.chain_index(grown, ["s"], "t", "g", base, "i")
    both = series.rebased(chained, ["s"], "t", "v", F.lit(base), "r")
    assert all(r.i == pytest.approx(r.r) for r in both.collect())
    assert both.filter(F.col("t") == base).first().i == 1.0


def test_one_type_keeps_its_own_path(spark):
    rnd = random.Random(4)
    rows = [("m", 0, t, rnd.uniform(0.5, 2), rnd.uniform(0, 0.5), 1.0) for t in range(8)]
    df = spark.createDataFrame(rows, "m string, type int, t int, c double, h double, w double")
    out = series.composition_series(df, ["m"], "type", "t", "c", "h", "w", base=2).orderBy("t").collect()
    assert [r.cons_index for r in out] == pytest.approx([r[3] / rows[2][3] for r in rows])
    assert [r.hazard for r in out] == pytest.approx([r[4] for r in rows])


def session_with(conf: dict):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(session_with({CHECKPOINT_CONF: "hdfs:///shared/", "spark.master": "yarn"})) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        shared_dir(session_with({"spark.master": "yarn"}))
    assert shared_dir(session_with({"spark.master": "local[2]"})).startswith("/tmp/run-")
    written = materialise(spark.range(5), "t")
    assert written.count() == 5 and shared_dir(spark) in written.inputFiles()[0]


def test_a_session_can_leave_no_files_behind(spark):
    def files():
        return set(Path(shared_dir(spark)).rglob("*.parquet"))

    others = files()
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0)], "x double, w double")
    assert weights.weighted_quantiles(df, [], "x", "w", {"m": 0.5}).first().m == 1.0
    assert files() - others
    clear(spark)
    assert not files() - others


def test_intermediates_of_a_block_go_at_its_end(spark, tmp_path):
    import os

    from tallyframe import session

    outer = materialise(spark.range(3), "outer")
    with pytest.raises(ZeroDivisionError), session.owned(spark):
        inner = materialise(spark.range(4), "inner")
        made = inner.inputFiles()[0].removeprefix("file:")
        assert inner.count() == 4 and os.path.exists(made)
        raise ZeroDivisionError
    assert not os.path.exists(made) and outer.count() == 3
    session.delete(spark, os.path.dirname(outer.inputFiles()[0]))
    assert not os.path.exists(outer.inputFiles()[0].removeprefix("file:"))
