"""Target vectors, fitted runs and agent types on published parameter values."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import quality, series
from tallyframe.sources import readers
from tallyframe.surveys import model_tables

# Published target vectors and fitted runs.
VECTORS = {
    "cons": [1.0, 1.007, 1.009, 0.997, 0.939, 0.928, 0.933, 0.918, 0.909, 0.901, 0.895, 0.777, 0.783, 0.77, 0.755, 0.744],
    "search": ["--"] * 5 + [0.193, 0.23, 0.212, 0.183, 0.188, 0.259, 0.24, 0.22, 0.148, 0.142, 0.067],
    "cons_se": [0.00142, 0.00142, 0.001376, 0.001345, 0.001346, 0.001441, 0.001748, 0.00217, 0.002832, 0.00444, 0.005631, 0.006254,
                0.006789, 0.007292, 0.007853, 0.008398],
    "search_se": [0.00294, 0.00483, 0.00613, 0.008, 0.01025, 0.01256, 0.0164, 0.02236, 0.02913, 0.03493, 0.03742],
}
RUNS = {
    "one_search": {"w_lo_k": 0.6731798511021848, "phi": 1.447434493220083, "GOF": 430.814965216458, "opt_type": "1b2k",
                   "k1": 129.50042695457782, "k0": 9.01957126432952, "beta_hyp": 1.0, "GOF_search": 81.23944106088987,
                   "L_": 4.487848419355983, "GOF_cons": 349.57552415556813, "beta_var": 0.989756126533513},
    "two_patience": {"w_lo_k": 0.6496978744808157, "phi": 1.0, "GOF": 194.1808587859334, "b0": 0.45025600580163555,
                     "opt_type": "2b2k_fix_xi", "GOF_cons": 117.16845120801841, "w_lo_beta": 0.19037871470567966, "k1": 33.50038012581068,
                     "k0": 3.398863890349866, "GOF_search": 77.01240757791498, "L_": 7.297986380962978, "beta_var": 0.9898660592752576,
                     "b1": 1.0},
}


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("v") / "vectors.json"
    path.write_text(json.dumps(VECTORS, indent=0))
    schema = ", ".join(f"{k} array<string>" for k in VECTORS)
    return model_tables.moment_vectors(readers.read_json_documents(spark, str(path), schema), list(VECTORS))


def test_targets_and_distance(vectors):
    cons = model_tables.target_window(vectors, "cons", "cons_se", 3, 9, errors_start=3, normalise_at=3)
    got = cons.orderBy("period").collect()
    assert [r.value for r in got] == pytest.approx([v / 0.997 for v in VECTORS["cons"][3:12]])
    assert [r.se for r in got] == VECTORS["cons_se"][3:12]
    search = model_tables.target_window(vectors, "search", "search_se", 5, 11)
    assert [(r.value, r.se) for r in search.orderBy("period").collect()] == list(zip(VECTORS["search"][5:], VECTORS["search_se"]))
    targets = cons.unionByName(search)
    model = targets.select("series", "period", (F.col("value") + 2 * F.col("se")).alias("value")).withColumn("name", F.lit("m"))
    out = series.fit_distance(model, targets, ["name"], "series", "period", "value", "se")
    assert {r.series: r.distance for r in out.collect()} == pytest.approx({"cons": 36.0, "search": 44.0, None: 80.0})


def test_runs_unfold_into_types(spark, tmp_path):
    (tmp_path / "runs.json").write_text(json.dumps(RUNS, indent=0))
    types = model_tables.agent_types(model_tables.read_fitted_runs(spark, str(tmp_path / "runs.json")))
    assert all(r["pass"] for r in quality.check_sum_to_one(types, ["run"], "init_share").collect())
    log = model_tables.fit_log(types).collect()
    assert [(r.run, r.type) for r in log] == [("two_patience", i) for i in range(4)] + [("one_search", i) for i in range(2)]
    run = RUNS["two_patience"]
    assert log[1].init_share == pytest.approx(run["w_lo_k"] * (1 - run["w_lo_beta"]))
    assert (log[1].k, log[1].beta, log[1].delta, log[1].xi) == (run["k0"], 1.0, run["beta_var"], 1.0)
    assert (log[5].k, log[5].beta, log[5].cons_GOF) == (RUNS["one_search"]["k1"], 1.0, RUNS["one_search"]["GOF_cons"])


def test_configurations_become_documents(spark, tmp_path):
    (tmp_path / "c.csv").write_text("opt_type,L_,k0\n2b2k,7,3\nopt_type,L_,k0\n2b2k,5.1,\n")
    model_tables.configuration_documents(spark, str(tmp_path / "c.csv"), ["opt_type", "L_", "k0"], str(tmp_path / "docs"))
    back = spark.read.schema("opt_type string, L_ double, k0 double").json(str(tmp_path / "docs"))
    assert sorted(map(tuple, back.collect())) == [("2b2k", 5.1, None), ("2b2k", 7.0, 3.0)]


def test_environment(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"z_vals": [1, 0.83, 0.54],\n "Pi": [[0.975, 0.025, 0], [0.193, 0, 0.807], [0.1, 0, 0.9]]}')
    doc = readers.read_json_documents(spark, str(tmp_path / "e.json"), "z_vals array<double>, Pi array<array<double>>")
    assert [tuple(r) for r in model_tables.states_of_environment(doc).collect()] == [(0, 1.0), (1, 0.83), (2, 0.54)]
    rows = model_tables.transitions_of_environment(doc)
    assert rows.count() == 9
    assert all(r["pass"] for r in quality.check_sum_to_one(rows, ["from_state"], "p").collect())
