"""Sources and sinks: write a driver table in the format, read it back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.functions.text import lenient_double
from tallyframe.operators.runs import complete_configurations
from tallyframe.plans.inputs import HISTORY, history
from tallyframe.plans.registry import Tables, query, rounded
from tallyframe.session import new_path
from tallyframe.sources import readers, writers

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(t: Tables):
    path = new_path(t.spark, "csv")
    t.customer.write.csv(path, header=True, quoteAll=True)
    return readers.read_csv(t.spark, path, CUSTOMER)


@query("""
SELECT segment, line, id, balance FROM (
  SELECT c_mktsegment AS segment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS line,
         c_custkey AS id, c_acctbal AS balance FROM customer) WHERE line BETWEEN 3 AND 202""")
def scan_skip(t: Tables):
    path = new_path(t.spark, "titled")
    body = t.customer.select(F.to_csv(F.struct("c_custkey", "c_mktsegment", "c_acctbal")).alias("value"))
    titled = body.unionByName(t.region.groupBy().agg(F.lit("Source: account survey,,").alias("value")))
    titled.unionByName(t.region.groupBy().agg(F.lit("id,segment,balance").alias("value"))).write.text(path)
    is_row = F.col("id").try_cast("long").isNotNull()
    raw = readers.read_csv_without_preamble(t.spark, path, ["id", "segment", "balance"], "id", keep=is_row)
    typed = raw.select(F.col("id").cast("long"), "segment", F.col("balance").cast("double"))
    return readers.line_range(typed, "segment", "id", skip=2, rows=200).select("segment", "line", "id", "balance")


@query("""
SELECT c_custkey AS id, nullif(c_mktsegment, 'BUILDING') AS segment,
       nullif(CAST(c_nationkey AS VARCHAR), '0') AS nation FROM customer""")
def scan_nulls(t: Tables):
    path = new_path(t.spark, "tokens")
    t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"),
    ).write.csv(path, header=True)
    return readers.null_tokens(
        readers.read_csv(t.spark, path, "id long, segment string, nation string", null_text=""), "0", ""
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
def scan_parquet(t: Tables):
    wanted = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 100000)
    return t.orders.filter(wanted).select("o_orderkey", "o_totalprice")


@query("""
SELECT CAST(year(o_orderdate) - 1994 AS INTEGER) AS wave, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1""")
def scan_waves(t: Tables):
    path = new_path(t.spark, "waves")
    wave = F.concat(F.lit("wave"), (F.year("o_orderdate") - 1994).cast("string"))
    writers.write_snapshot(t.orders.withColumn("file", wave), path, partition_by=["file"])
    waves = readers.read_waves(t.spark, path)
    return rounded(waves.groupBy("wave").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2, "total")


@query("SELECT c_custkey, c_acctbal FROM customer")
def strip_metadata(t: Tables):
    labelled = t.customer.select(
        F.col("c_custkey").alias("c_custkey", metadata={"label": "case"}),
        F.col("c_acctbal").alias("c_acctbal", metadata={"label": "balance", "is_na": "-1"}),
    )
    return readers.without_metadata(labelled)


@query(f"""
WITH {HISTORY}, moves AS (
  SELECT CAST(floor(period / 7) AS BIGINT) AS week, state > 0 AS now, lag(state > 0) OVER (PARTITION BY agent ORDER BY period) AS prior
  FROM history), shares AS (
  SELECT week, 0 AS from_state, 0 AS to_state, avg(CASE WHEN now THEN 0.0 ELSE 1.0 END) AS p FROM moves WHERE NOT prior GROUP BY week
  UNION ALL SELECT week, 0, 1, avg(CASE WHEN now THEN 1.0 ELSE 0.0 END) FROM moves WHERE NOT prior GROUP BY week
  UNION ALL SELECT week, 1, 0, avg(CASE WHEN now THEN 0.0 ELSE 1.0 END) FROM moves WHERE prior GROUP BY week
  UNION ALL SELECT week, 1, 1, avg(CASE WHEN now THEN 1.0 ELSE 0.0 END) FROM moves WHERE prior GROUP BY week)
SELECT week, from_state, to_state, round(p, 6) AS p FROM shares""")
def scan_json_params(t: Tables):
    path = new_path(t.spark, "params")
    out_of_work = F.col("state") > 0
    moves = history(t).select(
        F.floor(F.col("period") / 7).alias("week"),
        out_of_work.alias("now"),
        F.lag(out_of_work).over(Window.partitionBy("agent").orderBy("period")).alias("prior"),
    )

    def p(prior: bool, now: bool):
        return F.avg(F.when(F.col("prior") == prior, (F.col("now") == now).cast("double")))

    documents = moves.groupBy("week").agg(
        F.array(F.array(p(False, False), p(False, True)), F.array(p(True, False), p(True, True))).alias("Pi")
    )
    writers.write_json(documents, path, one_per_file=True)
    back = readers.read_json_documents(t.spark, path, "week long, Pi array<array<double>>")
    return rounded(readers.matrix_to_long(back, ["week"], "Pi"), 6, "p")


CONFIGS = """configs AS (
  SELECT o_orderpriority AS opt_type, CAST(c_nationkey AS BIGINT) AS run, round(avg(o_totalprice), 4) AS fit,
         round(min(o_totalprice), 2) AS k0
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


def configs(t: Tables):
    """Run configurations: a model type, a run number, a fit and a parameter."""
    return (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(F.col("o_orderpriority").alias("opt_type"), F.col("c_nationkey").cast("long").alias("run"))
        .agg(F.round(F.avg("o_totalprice"), 4).alias("fit"), F.round(F.min("o_totalprice"), 2).alias("k0"))
    )


@query(f"WITH {CONFIGS} SELECT opt_type, run, fit, k0 FROM configs")
def rows_to_json(t: Tables):
    table, documents = new_path(t.spark, "configs"), new_path(t.spark, "documents")
    names = ["opt_type", "run", "fit", "k0"]
    lines = configs(t).select(*[F.col(c).cast("string").alias(c) for c in names])
    repeated = t.region.select(*[F.lit(c).alias(c) for c in names])
    lines.unionByName(repeated).write.csv(table, header=True)
    text = readers.read_csv(t.spark, table, ", ".join(f"{c} string" for c in names))
    kept = complete_configurations(text, "opt_type").select(
        "opt_type", F.col("run").cast("long"), lenient_double(F.col("fit")).alias("fit"), lenient_double(F.col("k0")).alias("k0")
    )
    writers.write_json(kept, documents)
    return t.spark.read.schema("opt_type string, run long, fit double, k0 double").json(documents)


@query(f"WITH {CONFIGS} SELECT opt_type, run, fit, k0 FROM configs WHERE opt_type IN ('1-URGENT', '2-HIGH')")
def scan_json_dir(t: Tables):
    folder = new_path(t.spark, "results")
    main = F.col("opt_type").isin("1-URGENT", "2-HIGH")
    named = configs(t).withColumn("file", F.when(main, F.lit("sim_main")).otherwise(F.lit("other")))
    for prefix in ("sim_main", "other"):
        writers.write_json(named.filter(F.col("file") == prefix).drop("file"), f"{folder}/{prefix}")
    return readers.read_result_documents(t.spark, folder, "sim_", "opt_type string, run long, fit double, k0 double")


@query("SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def sink_csv(t: Tables):
    path = new_path(t.spark, "csv")
    joined = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    writers.write_csv(joined.groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("n")), path)
    return readers.read_csv(t.spark, path, "n_nationkey int, n_name string, n long")


@query("SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) - 1994 AS INTEGER) AS wave FROM orders")
def sink_parquet(t: Tables):
    path = new_path(t.spark, "snapshot")
    rows = t.orders.select("o_orderkey", "o_totalprice", (F.year("o_orderdate") - 1994).alias("wave"))
    writers.write_snapshot(rows, path, partition_by=["wave"])
    return t.spark.read.schema("o_orderkey long, o_totalprice double, wave int").parquet(path)


@query("""
SELECT s_nationkey AS nation, round(avg(s_acctbal), 4) AS mean_balance,
       max(CASE WHEN s_acctbal > 9000 THEN s_acctbal END) AS top_balance FROM supplier GROUP BY 1""")
def sink_json(t: Tables):
    path = new_path(t.spark, "json")
    stats = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.round(F.avg("s_acctbal"), 4).alias("mean_balance"),
        F.max(F.when(F.col("s_acctbal") > 9000, F.col("s_acctbal"))).alias("top_balance"),
    )
    writers.write_json(stats, path)
    return t.spark.read.schema("nation int, mean_balance double, top_balance double").json(path)
