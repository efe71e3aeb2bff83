"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest
from compare import connection, differences

import __spark_entry__ as entry
from tallyframe.plans.registry import ORACLES as SQL
from tallyframe.plans.registry import QUERIES
from tallyframe.session import owned

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    with owned(spark):
        assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


def test_a_cohort_without_a_known_mean_keeps_its_row(spark, tmp_path):
    # users 1 and 2 lose their work on day 12, three errors; a day of the window before it has no known value
    rows = [(u, f"2024-01-{d + 1:02d} 10:00:00", "click", None if d == 5 else 10.0 * u + d) for u in (1, 2) for d in range(13)]
    rows += [(u, "2024-01-13 11:00:00", "error", 1.0) for u in (1, 2) for _ in range(3)]
    df = spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double")
    df.withColumn("ts", df.ts.cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    with owned(spark):
        out = QUERIES["representativeness_table"](spark, str(tmp_path))
        assert differences(out, own, SQL["representativeness_table"]) == []
        got = {tuple(r[c] for c in ("key", "median_cons", "cons", "effort", "up")) for r in out.collect()}
    labels = ("Unemployed: All", "Unemployed: Benefit", "Unemployed: Benefit, paid by transfer")
    assert got == {(label, None, None, 0.1, None) for label in labels}


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
