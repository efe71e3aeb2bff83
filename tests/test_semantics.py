"""Small hand-written tables for the places where survey scripts and Spark differ."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import numbers, text
from tallyframe.operators import crosswalk, history, inference, panel, quality, reshape, runs, series, weights
from tallyframe.sources import readers, writers


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_entities_without_event_drop_out_of_comparisons(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 14, True), ("b", 14, False)], "id string, t int, f boolean")
    out = panel.event_study(df, "id", "t", {"ui": "f"})
    assert out.filter("first_ui_date >= 13").count() == 0
    assert rows_of(out.select("id", "t", "first_ui_date", "last_ui_date", "time_since_ui_end", "ui_t_wave"), "id", "t") == [
        ("a", 1, 1, 14, -13, 0),
        ("a", 14, 1, 14, 0, 12),
        ("b", 14, None, None, None, None),
    ]


def test_wave_of_negative_offset_rounds_down(spark):
    df = spark.createDataFrame([(-1,), (-4,), (-5,), (3,), (4,)], "t int")
    assert [r.w for r in df.select(numbers.wave_start(F.col("t")).alias("w")).collect()] == [-4, -4, -8, 0, 4]


def test_ever_flags_skip_null(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, True), ("b", 1, None), ("b", 2, False)], "id string, t int, f boolean")
    out = panel.flag_events(df, "id", "t", {}, {}, {"any_f": "f"}).select("id", "any_f").distinct()
    assert rows_of(out, "id") == [("a", True), ("b", False)]


def test_transition_does_not_leak_between_entities(spark):
    df = spark.createDataFrame(
        [("a", 1, True, False), ("a", 2, True, True), ("b", 1, False, True), ("b", 2, False, True)],
        "id string, t int, sep boolean, unemp boolean",
    )
    out = panel.flag_events(df, "id", "t", {}, {"moved": ("sep", F.col("unemp"))}, {})
    assert [r.moved for r in out.orderBy("id", "t").collect()] == [False, True, False, False]


def test_ratio_by_zero_is_null(spark):
    assert one(spark, numbers.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numbers.ratio(F.lit(0.0), F.lit(0.0))) is None


def test_percent_text_rounds_half_even(spark):
    assert [one(spark, text.percent_text(F.lit(x))) for x in (0.025, 0.035, 0.125, 0.996, 1.0)] == ["2%", "4%", "12%", "100%", "100%"]


def test_placebo_draw_is_per_entity_and_reproducible(spark):
    df = spark.createDataFrame([(i, t, 1.0) for i in range(60) for t in range(1, 41)], "id int, t int, earn double")
    out = panel.pseudo_event(df, "id", "t", F.col("earn") > 0, earliest=16, seed=123)
    dates = {r.id: r.pseudo_date for r in out.collect()}
    assert all(16 <= d < 40 for d in dates.values()) and len(set(dates.values())) > 8
    again = panel.pseudo_event(df.repartition(5), "id", "t", F.col("earn") > 0, earliest=16, seed=123)
    assert {r.id: r.pseudo_date for r in again.collect()} == dates


def test_placebo_is_void_when_not_at_risk_or_unseen(spark):
    df = spark.createDataFrame([("a", 10, 1.0), ("b", 16, 0.0), ("b", 17, 0.0), ("c", 30, 1.0)], "id string, t int, earn double")
    out = panel.pseudo_event(df, "id", "t", F.col("earn") > 0, earliest=16, seed=1)
    assert {r.id: r.pseudo_date for r in out.collect()}["a"] is None
    assert {r.id: r.pseudo_date for r in out.collect()}["b"] is None


def test_deflate_on_either_index(spark):
    prices = spark.createDataFrame([(1, 100.0), (2, 110.0), (3, 121.0)], "m int, p double")
    df = spark.createDataFrame([(1, 2, 10.0), (9, 3, 10.0)], "interview int, calendar int, x double")
    by_calendar = panel.deflate(df, prices, "calendar", "m", "p", ["x"])
    assert [r.x_adj for r in by_calendar.orderBy("interview").collect()] == pytest.approx([11.0, 10.0])
    by_interview = panel.deflate(df, prices, "interview", "m", "p", ["x"])
    assert [r.x_adj for r in by_interview.orderBy("interview").collect()] == [pytest.approx(12.1), None]


def test_ties_at_the_maximum_are_kept(spark):
    spend = spark.createDataFrame(
        [(1, -5.0, "g "), (1, -5.0, "h"), (1, -2.0, "g"), (2, -1.0, None), (3, -9.0, "x"), (None, -9.0, "x"), (4, -1.0, " y ")],
        "code int, dollars double, grp string",
    )
    labels = spark.createDataFrame([(1, "one")], "code int, label string")
    out = crosswalk.code_spend(spend, labels, code="code", dollars="dollars", group="grp", label="label", customer_months=10.0, excluded=[3])
    assert rows_of(out, "code", "grp") == [(1, 5.0, 0.5, "g", "one"), (1, 5.0, 0.5, "h", "one"), (4, 1.0, 0.1, "y", None)]


def test_weight_of_a_null_value_is_dropped(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 100.0), (3.0, 1.0)], "x double, w double")
    assert df.agg(weights.weighted_mean(F.col("x"), F.col("w")).alias("m")).first().m == 2.0


def test_total_row_skips_null_cells_and_survives_a_null_label(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 2.0)], "p string, v double")
    assert sorted(rows_of(reshape.total_row(df, "p", ["v"])), key=str) == sorted(
        [("a", 1.0), ("b", None), (None, 2.0), ("Total", 3.0)], key=str
    )


def test_distributions_match_on_the_bin_not_on_position(spark):
    a = spark.createDataFrame([(5.0, 1.0), (15.0, 3.0)], "x double, w double")
    b = spark.createDataFrame([(15.0, 2.0), (25.0, 2.0)], "x double, w double")
    bins = {"x": numbers.floor_bin(F.col("x"), 10)}
    out = weights.multi_distribution([(a, "w", {"a": bins["x"]}), (b, "w", {"b": bins["x"]})])
    assert rows_of(out, "bin") == [(0.0, 1.0, 0.25, None, None), (10.0, 3.0, 0.75, 2.0, 0.5), (20.0, None, None, 2.0, 0.5)]


def test_bins_with_top_and_bottom(spark):
    df = spark.createDataFrame([(-7.0,), (0.0,), (499.9,), (500.0,), (99999.0,), (None,)], "x double")
    plain = df.select(numbers.floor_bin(F.col("x"), 500, top=1000).alias("b"))
    assert [r.b for r in plain.collect()] == [-500.0, 0.0, 0.0, 500.0, 1000.0, None]
    clamped = df.select(numbers.floor_bin(F.col("x"), 500, top=1000, bottom=0).alias("b"))
    assert [r.b for r in clamped.collect()] == [0.0, 0.0, 0.0, 500.0, 1000.0, None]


def test_reallocation_uses_the_snapshot_before_the_stage(spark):
    amounts = spark.createDataFrame([("a", 10.0), ("b", 100.0), ("c", 7.0), ("d", 1.0)], "category string, amount double")
    sources = amounts.withColumnRenamed("category", "source")
    rules = spark.createDataFrame(
        [("a", "a", 0.5, "set"), ("b", "a", 0.5, "add"), ("c", "none", 1.0, "set"), ("d", "none", 1.0, "add")],
        "category string, source string, coef double, mode string",
    )
    out = crosswalk.reallocate(amounts, sources, rules, "category", "amount")
    assert rows_of(out, "category") == [("a", 5.0), ("b", 105.0), ("c", None), ("d", 1.0)]


@pytest.mark.parametrize("seed", range(5))
def test_reallocation_with_balanced_rules_preserves_the_total(spark, seed):
    import random

    rnd = random.Random(seed)
    names = list("abcdef")
    amounts = [(n, rnd.uniform(1, 100)) for n in names]
    rules = []
    for source in names:
        parts = [rnd.random() for _ in range(3)]
        rules += [(t, source, p, "add") for t, p in zip(rnd.sample(names, 3), parts)]
        rules.append((source, source, -sum(parts), "add"))
    df = spark.createDataFrame(amounts, "category string, amount double")
    table = spark.createDataFrame(rules, "category string, source string, coef double, mode string")
    out = crosswalk.reallocate(df, df.withColumnRenamed("category", "source"), table, "category", "amount")
    assert out.agg(F.sum("amount")).first()[0] == pytest.approx(sum(a for _, a in amounts))


def test_ratios_come_before_rounding(spark):
    options = spark.createDataFrame([("ND", "x"), ("D", "y"), ("D", "z")], "grp string, category string")
    spend = spark.createDataFrame([("x", 1.4), ("y", 0.0)], "category string, spend double")
    bench = spark.createDataFrame([("x", 0.6), ("y", 5.0)], "category string, bench double")
    out = crosswalk.coverage_table(
        options, {"spend": spend, "bench": bench}, category="category", group="grp", group_levels=["D", "ND"],
        ratios={"r": ("spend", "bench")},
    ).select("grp", "category", "spend", "bench", "r")
    assert [tuple(r) for r in out.collect()] == [("D", "y", 0.0, 5.0, 0.0), ("D", "z", None, None, None), ("ND", "x", 1.0, 1.0, 2.33)]


def test_labels_one_row_above_their_amounts(spark):
    printed = [("Food", None), ("Mean", "$1,200.50"), ("Share", "12.5"), ("SE", "0.3"), ("Housing", None), ("Mean", "90"), ("Share", "a/")]
    df = spark.createDataFrame([("f", i, a, b) for i, (a, b) in enumerate(printed)], "source string, place int, label string, value string")
    out = crosswalk.align_offset_rows(df, source="source", order="place", label="label", value="value", headings=["Mean", "Share", "SE"])
    assert rows_of(out, "line") == [("f", 1, "Food", 1200.5), ("f", 2, "Housing", 90.0)]


def test_benchmark_lines_missing_lines_count_as_zero(spark):
    mapping = spark.createDataFrame([("a", 1, 2), ("b", 3, None), ("c", 9, None)], "category string, l1 int, l2 int")
    bench = spark.createDataFrame([(1, 12.0), (2, 24.0), (3, 6.0)], "line int, amount double")
    out = crosswalk.benchmark_lines(mapping, bench, category="category", line_columns=["l1", "l2"], line="line", amount="amount", name="x", divisor=12)
    assert rows_of(out, "category") == [("a", 3.0), ("b", 0.5), ("c", 0.0)]


def test_chain_index_is_one_at_base_and_null_past_a_total_loss(spark):
    df = spark.createDataFrame([(0, None), (1, 0.1), (2, -0.5), (3, 1.0)], "t int, g double").withColumn("s", F.lit("s"))
    out = series.chain_index(df, ["s"], "t", "g", 1, "i")
    assert [r.i for r in out.orderBy("t").collect()] == pytest.approx([1 / 1.1, 1.0, 0.5, 1.0])
    loss = spark.createDataFrame([(0, None), (1, -1.0), (2, 0.5)], "t int, g double").withColumn("s", F.lit("s"))
    assert [r.i for r in series.chain_index(loss, ["s"], "t", "g", 2, "i").orderBy("t").collect()] == [None, None, None]


def test_composition_follows_the_recurrence(spark):
    cons = {0: [1.0, 0.9, 0.8, 0.85], 1: [2.0, 2.1, 1.5, 1.2]}
    haz = {0: [0.0, 0.5, 0.2, 0.1], 1: [0.0, 0.1, 0.3, 1.0]}
    start = {0: 0.3, 1: 0.7}
    rows = [("m", k, t, cons[k][t], haz[k][t], start[k]) for k in cons for t in range(4)]
    df = spark.createDataFrame(rows, "m string, type int, t int, cons double, haz double, w double")
    left = {k: [start[k]] for k in cons}
    for k in cons:
        for t in range(1, 4):
            left[k].append(left[k][-1] * (1 - haz[k][t - 1]))
    share = {k: [left[k][t] / sum(left[j][t] for j in cons) for t in range(4)] for k in cons}
    growth = [sum(share[k][t] * (cons[k][t] / cons[k][t - 1] - 1) for k in cons) if t else 0.0 for t in range(4)]
    want = [0.0] * 4
    want[1] = 1.0
    want[0] = want[1] / (1 + growth[1])
    for t in (2, 3):
        want[t] = want[t - 1] * (1 + growth[t])
    got = series.composition_series(df, ["m"], "type", "t", "cons", "haz", "w", base=1).orderBy("t").collect()
    assert [r.cons_index for r in got] == pytest.approx(want)
    assert [r.hazard for r in got] == pytest.approx([sum(share[k][t] * haz[k][t] for k in cons) for t in range(4)])
    level = series.composition_series(df, ["m"], "type", "t", "cons", "haz", "w", base=1, normalise=False).orderBy("t").collect()
    base = sum(share[k][1] * cons[k][1] for k in cons)
    assert [r.cons_index for r in level] == pytest.approx([w * base for w in want])


def test_moments_are_padded_in_front_and_repaired(spark):
    df = spark.createDataFrame(
        [("s", t, 1.0005 + t, 0.5 * t, None, None) for t in range(3)] + [("h", 5, 0.25, None, 0.1, 0.492)],
        "series string, period int, value double, se double, low double, high double",
    )
    longest = spark.sql("SELECT 3 AS n")
    out = rows_of(series.target_moments(df, longest), "series", "position")
    assert out[:3] == [("h", 1, None, None), ("h", 2, None, None), ("h", 3, 0.25, 0.1)]
    assert [r[3] for r in out[3:]] == [0.0, 0.5, 1.0]
    out = rows_of(series.target_moments(df, longest, repair=["s"], digits={"s": 1, "h": 0}, se_digits={"h": 2}), "series", "position")
    assert out[2] == ("h", 3, 0.0, 0.1) and [r[3] for r in out[3:]] == [0.5, 0.5, 1.0] and out[3][2] == 1.0


def test_only_the_named_series_is_repaired(spark):
    rows = [("cons", t, 1.0, v, None, None) for t, v in enumerate([0.0, 0.00161, 0.00172])]
    rows += [("search", t, 0.2, v, None, None) for t, v in enumerate([0.00294, 0.00301, 0.00311])]
    df = spark.createDataFrame(rows, "series string, period int, value double, se double, low double, high double")
    out = rows_of(series.target_moments(df, spark.sql("SELECT 3 AS n"), repair=["cons"]), "series", "position")
    assert [r[3] for r in out] == [0.00161, 0.00161, 0.00172, 0.00294, 0.00301, 0.00311]


def test_mixture_weights_sum_to_one(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0, 0.3, 5.0, 6.0, 0.9)], "run string, k0 double, k1 double, wk double, b0 double, b1 double, wb double")
    out = series.type_mixture(df, ["run"], {"k": (F.col("k0"), F.col("k1"), F.col("wk")), "b": (F.col("b0"), F.col("b1"), F.col("wb"))})
    assert [r[:4] for r in rows_of(out, "type")] == [("m", 0, 1.0, 5.0), ("m", 1, 1.0, 6.0), ("m", 2, 2.0, 5.0), ("m", 3, 2.0, 6.0)]
    assert [r.weight for r in out.orderBy("type").collect()] == pytest.approx([0.27, 0.03, 0.63, 0.07])
    assert quality.check_sum_to_one(out, ["run"], "weight").first()["pass"]


def test_onset_ignores_agents_that_start_in_the_state(spark):
    df = spark.createDataFrame(
        [(1, 0, 1, 5.0), (1, 1, 2, 4.0), (2, 0, 0, 10.0), (2, 1, 1, 7.0), (2, 2, 2, 6.0), (2, 3, 0, 9.0), (2, 4, 1, 8.0)],
        "agent int, t int, state int, c double",
    )
    assert [r.onset_drop for r in history.onset_drops(df, "agent", "t", "state", "c").orderBy("t").collect()] == [3.0, 1.0]


def test_onset_needs_the_period_before(spark):
    df = spark.createDataFrame(
        [(1, 1, 0, 9.0), (1, 9, 1, 4.0), (2, 3, 0, 8.0), (2, 4, 1, 7.0), (3, 5, 0, 6.0), (3, 6, 1, 3.0)], "agent int, t int, state int, c double"
    )
    assert sorted(r.onset_drop for r in history.onset_drops(df, "agent", "t", "state", "c").collect()) == [1.0, 3.0]
    profile = {r.statistic: r.value for r in history.onset_profile(df, "agent", "t", "state", "c").collect()}
    assert profile["onset_drop_mean"] == 2.0 and profile["onset_drop_50th"] == 2.0
    means = history.state_occupancy(df, [], "state", "c", means=["c"]).first()
    assert means.avg_c == pytest.approx(37 / 6) and means.employment_rate == 0.5


def test_an_unknown_amount_leaves_the_prior_mean_unknown(spark):
    rows = [(i, t, 10.0 if (i, t) != (1, 2) else None, 5) for i in (1, 2) for t in range(1, 6)]
    df = spark.createDataFrame(rows, "id int, t int, x double, start int")
    out = panel.prior_window_mean(df, "id", "t", "start", {"m": "x"}).select("id", "m", "mos_in_horizon").distinct().collect()
    assert {(r.id, r.m, r.mos_in_horizon) for r in out} == {(1, None, 4), (2, 10.0, 4)}
    out = panel.cohort_stack(df, "id", "t", {"all": ("start", None)}, {"m": "x"}, window=(4, 1)).select("id", "m").distinct()
    assert {(r.id, r.m) for r in out.collect()} == {(1, None), (2, 10.0)}


def test_distance_counts_every_term(spark):
    model = spark.createDataFrame([("m", "s", t, 1.0 + t) for t in range(3)] + [("m", "q", 0, 2.0)], "name string, series string, t int, v double")
    target = spark.createDataFrame([("s", 0, 0.0, 0.5), ("s", 1, 6.0, 0.0), ("s", 7, 1.0, 1.0), ("q", 0, 1.0, 0.5)], "series string, t int, v double, se double")
    out = series.fit_distance(model, target, ["name"], "series", "t", "v", "se").collect()
    # s: a zero error, a period without target, a target without period
    assert {r.series: (r.distance, r.undefined) for r in out} == {"s": (None, 3), "q": (4.0, 0), None: (None, 3)}


def test_zero_denominators_are_null(spark):
    facts = spark.createDataFrame([(1.0, False, False), (2.0, False, False)], "w double, card boolean, one boolean")
    row = weights.survey_facts(
        facts, "w", {"any": (F.lit(True), F.col("card"), False)}, derived={"part": 1 - numbers.ratio(F.lit(0.37), F.col("any"))}
    ).first()
    assert row["any"] == 0 and row["part"] is None


def test_npv_masks_use_the_floor(spark):
    df = spark.createDataFrame([(1, 0, 0, 2.0, 0.5), (1, 1, 1, 1.0, 0.5)], "agent int, t int, state int, c double, s double")
    r = history.npv_by_entity(df, ["agent"], "t", "state", "c", "s", rate=0.1, rho=2.0, k=2.0, phi=1.0).first()
    assert r.u_cons == pytest.approx(-0.5 - 1 / 1.1)
    assert r.u_cons_ue == pytest.approx(-1 / 0.0001 - 1 / 1.1)
    assert r.u_cons_emp == pytest.approx(-0.5 - 1 / 0.0001 / 1.1)
    assert r.u_search == pytest.approx(-0.25 / 1.1)


def test_budget_neutral_change_balances(spark):
    occupancy = spark.createDataFrame([(0, 0.9), (1, 0.05), (2, 0.03), (3, 0.02)], "state int, share double").withColumn("g", F.lit(1))
    pay = spark.createDataFrame([(0, 1.0), (1, 0.6), (2, 0.5), (3, 0.2)], "state int, pay double")
    r = history.budget_neutral_change(occupancy, pay, ["g"], "state", "pay", last_covered=2, cost_extension=1.5, cost_increase=1.2).first()
    assert r.tax * 0.9 == pytest.approx(1.5 * 0.02 * 0.3)
    assert r.benefit_change * 0.08 * 1.2 == pytest.approx(r.tax * 0.9)


def test_sandwich_equals_numpy(spark):
    import numpy as np

    g = np.array([[1.0, 2.0], [0.5, -1.0], [3.0, 0.1]])
    w = np.array([2.0, 4.0, 0.5])
    grad = spark.createDataFrame([(m, p, float(g[m, i])) for m in range(3) for i, p in enumerate("ab")], "moment int, parameter string, partial double")
    weight = spark.createDataFrame([(m, float(w[m])) for m in range(3)], "moment int, w double")
    gram = inference.weighted_gram(grad, "moment", "parameter", ["a", "b"], weight, "w")
    got = inference.parameter_variances(gram, gram, ["a", "b"])
    assert got == pytest.approx(np.linalg.inv(g.T @ np.diag(w) @ g))
    assert inference.parameter_variances(gram, gram, ["a", "b"], divide_by_count=True) == pytest.approx(got / 2)


def test_runs_are_ranked_and_ties_broken(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 3.0), ("a", 3, 3.0), ("b", 1, 9.0)], "model string, run int, fit double")
    assert [tuple(r) for r in runs.collate_runs(df, "model", "fit", "run").collect()] == [("a", 2, 3.0, 1), ("a", 3, 3.0, 2), ("a", 1, 5.0, 3), ("b", 1, 9.0, 1)]
    assert rows_of(runs.best_runs(df, "model", "fit", "run"), "model") == [("a", 2, 3.0), ("b", 1, 9.0)]


def test_expected_facts_fail_when_missing(spark):
    actual = spark.createDataFrame([("a", 0.852), ("b", 0.1)], "fact string, value double")
    expected = spark.createDataFrame([("a", "85%"), ("b", "11%"), ("c", "1%")], "fact string, expected string")
    out = quality.check_expected(actual, expected, "fact", text.percent_text(F.col("value")))
    assert [(r.fact, r["pass"]) for r in out.orderBy("fact").collect()] == [("a", True), ("b", False), ("c", False)]


def test_alignment_check_counts_both_sides(spark):
    a = spark.createDataFrame([("s", 1), ("s", 2)], "series string, t int")
    b = spark.createDataFrame([("s", 2), ("s", 3), ("r", 1)], "series string, t int")
    assert tuple(quality.check_aligned(a, b, ["series", "t"]).first()) == (1, 2, False)
    assert tuple(quality.check_aligned(a, a, ["series", "t"]).first()) == (0, 0, True)


def test_csv_with_byte_order_mark_and_bare_cr(spark, tmp_path):
    (tmp_path / "prices.csv").write_bytes("﻿day,price\r2004-01-01,186.3\r2004-02-01,186.7\r".encode())
    out = readers.read_csv(spark, str(tmp_path / "prices.csv"), "day date, price double")
    assert [(str(r.day), r.price) for r in out.collect()] == [("2004-01-01", 186.3), ("2004-02-01", 186.7)]


def test_title_lines_above_the_header(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes('﻿"Source: somewhere, 2015",,\r\nDate,State,Weekly\r\n1/31/15,Ohio,$224.55 \r\n,,\r\n'.encode())
    keep = F.col("Date").rlike(r"^\d+/\d+/\d+$")
    out = readers.read_csv_without_preamble(spark, str(tmp_path / "b.csv"), ["Date", "State", "Weekly"], "Date", keep)
    assert rows_of(out.select("State", text.money_to_double(F.col("Weekly")))) == [("Ohio", 224.55)]


def test_metadata_is_gone(spark):
    df = spark.range(1).select(F.col("id").alias("id", metadata={"label": "x"}))
    assert df.schema["id"].metadata and not readers.without_metadata(df).schema["id"].metadata


def test_null_json_fields_stay(spark, tmp_path):
    writers.write_json(spark.sql("SELECT 1 AS a, CAST(NULL AS DOUBLE) AS b"), str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":1,"b":null}']


def test_padded_moment_vectors_from_json(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"search": ["--", "--", 0.193],\n "cons": [1.0, 1.007, 1.009]}')
    df = readers.read_json_documents(spark, str(tmp_path / "m.json"), "search array<string>, cons array<double>")
    cells = df.select(F.posexplode("search").alias("t", "v")).select("t", text.lenient_double(F.col("v")))
    assert rows_of(cells, "t") == [(0, None), (1, None), (2, 0.193)]


def test_gram_of_as_many_parameters_as_one_pass_takes(spark):
    import numpy as np
    from tallyframe.operators import inference

    k = inference.MOST_PARAMETERS
    names = [f"p{i}" for i in range(k)]
    partial = np.random.default_rng(5).normal(size=(6, k))
    grad = spark.createDataFrame([(m, names[i], float(partial[m, i])) for m in range(6) for i in range(k)], "moment int, parameter string, partial double")
    weight = spark.createDataFrame([(m, 1.0 + m) for m in range(6)], "moment int, w double")
    rows = inference.weighted_gram(grad, "moment", "parameter", names, weight, "w").collect()
    want = partial.T @ np.diag(1.0 + np.arange(6)) @ partial
    assert len(rows) == k * k
    assert all(abs(r.value - want[int(r.param_i[1:]), int(r.param_j[1:])]) < 1e-9 for r in rows)
    with pytest.raises(ValueError, match="at most"):
        inference.weighted_gram(grad, "moment", "parameter", [*names, "more"], weight, "w")
