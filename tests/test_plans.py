"""Physical plans: no cross joins, no Python evaluation, pruned scans, few shuffles."""

import re

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from tallyframe.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "ExistingRDD["]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_forbidden_nodes(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not [node for node in FORBIDDEN if node in text]


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(QUERIES["scan_parquet"](spark, FOLDER))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(o_orderpriority,1-URGENT)" in text and "GreaterThan(o_totalprice,100000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in text


@pytest.mark.parametrize("name", ["event_time", "flag_events", "event_study", "prior_window_mean", "pseudo_event"])
def test_panel_windows_share_one_shuffle_on_the_entity(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    # one for the aggregation to (entity, period), one for every window over the entity
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2


@pytest.mark.parametrize("name", ["weighted_mean", "weighted_histogram", "survey_facts", "agg_conditional", "npv_by_entity"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    assert "partial_sum" in plan(QUERIES[name](spark, FOLDER))


def test_price_index_is_broadcast_and_the_panel_not_shuffled_by_month(spark):
    text = plan(QUERIES["deflate"](spark, FOLDER))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
