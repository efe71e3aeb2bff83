"""Mixing sources to target weights by nested hash thresholds, without a sort.

A document's size is its number of words.  Sources in code point order (null last) weigh
1, 2, 3, 1, 2, 3, ... and share all words; no target is above ``repeats`` times its
source's size, and what that leaves over goes to the others by weight.  A source is
taken as often as its target holds it whole; the rest of the target comes from the
documents whose hash of the id lies below a threshold.  A larger target so holds all
documents of a smaller one.

The threshold comes from sums of words by source and hash cell.  The cell in which the
running sum meets the target is split again, then counted hash by hash, so each look at
the table sums a 4096th of what the one before did.  The document on the border is taken
if that brings the sum nearer to the target.

Everything per source (a row each) is one small table; the window that ranks sources
works on that table only.  A hot source is summed before any exchange like others.

Defined cases: a null text has no words; a source without words has target 0; repeated
ids are taken or left together; null ids share one hash; an empty table gives no rows;
other columns are ignored, in the pipeline they are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.tables import packed, read, unpacked, whole_text, written

WORD = r"[^\x20\x09-\x0D]+"
REPEATS, CELL_BITS, HASH_BITS = 3, 12, 60
EXACT = "decimal(38,0)"


def words(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def hash_of(column: str) -> Column:
    """60 bits of a hash that any engine can repeat."""
    digits = F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target, whole (full rounds) and wanted (words beyond them), from a row per source."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", ((F.col("rank") - 1) % 3 + 1).cast("long"))
    size, w = F.col("source_size").cast(EXACT), F.col("w").cast(EXACT)
    full = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") * float(repeats) / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    filled = ranked.select(
        "*", F.sum(size).over(full).alias("total"), F.sum(w).over(full).alias("weights"),
        (F.sum(size * repeats).over(order) - size * repeats).alias("before"), (F.sum(w).over(order) - w).alias("passed"),
    )
    # the first sources in order of size for their weight reach their limit
    limit = size * repeats
    at_limit = (limit * (F.col("weights") - F.col("passed"))).cast(EXACT) <= (w * (F.col("total") - F.col("before"))).cast(EXACT)
    filled = filled.withColumn("full", at_limit)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), limit)).over(full), F.lit(0))
    share = F.sum(F.when(~F.col("full"), w)).over(full)
    filled = filled.select("source", "source_size", "full", (w * rest).cast(EXACT).alias("up"), share.cast(EXACT).alias("down"))
    own = F.col("up").cast("double") / F.col("down").cast("double")
    rounds = F.expr("up div (down * source_size)").cast("long")
    return filled.select(
        "source", "source_size",
        F.when(F.col("full"), (F.col("source_size") * repeats).cast("double")).otherwise(own).alias("target"),
        F.when(F.col("source_size") == 0, 0).when(F.col("full"), repeats).otherwise(rounds).cast("long").alias("whole"),
    ).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _meeting(sums: DataFrame, cell: str) -> DataFrame:
    """The row of each source in whose words the running sum reaches ``wanted``; sums have source, cell, words, before, wanted."""
    run = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("after", F.col("before") + F.sum("words").over(run)).withColumn("before", F.col("after") - F.col("words"))
    return sums.filter((F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("after")))


def plan(sized: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Per source: source_size, target, whole and limit; a document is taken whole times, and once more if hash < limit.

    ``sized`` has source, size and hash and is read three times; it should be written.
    """
    first = HASH_BITS - CELL_BITS
    cells = written(
        sized.groupBy("source", F.shiftright("hash", first).alias("cell")).agg(F.sum("size").alias("words")), "mix-cells"
    )
    goals = written(targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), repeats), "mix-goals")
    want = goals.filter(F.col("wanted") > 0)
    sums = cells.join(want, _same_source(cells, want)).select(cells["source"], "cell", "words", "wanted", F.lit(0).cast("long").alias("before"))
    edge = written(_meeting(sums, "cell").select("source", "cell", "before", "wanted"), "mix-edge")
    for shift in (first - CELL_BITS, 0):
        inside = F.shiftright("hash", first) == edge["cell"]
        near = sized.join(edge, _same_source(sized, edge) & inside)
        near = near.groupBy(sized["source"], F.shiftright("hash", shift).alias("fine"), "before", "wanted").agg(F.sum("size").alias("words"))
        near = _meeting(near, "fine")
        first = shift
        edge = written(near.select("source", F.col("fine").alias("cell"), "before", "after", "wanted"), "mix-edge")
    nearer = F.col("after") - F.col("wanted") <= F.col("wanted") - F.col("before")
    limits = edge.select("source", (F.col("cell") + F.when(nearer, 1).otherwise(0)).alias("limit"))
    found = goals.join(limits, _same_source(goals, limits), "left")
    return written(
        found.select(goals["source"], "source_size", "target", "whole", F.coalesce("limit", F.lit(0).cast("long")).alias("limit")), "mix-plan"
    )


def rounds() -> Column:
    return (F.col("whole") + F.when(F.col("hash") < F.col("limit"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target and taken for every document."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        words().alias("size"), hash_of("doc_id").alias("hash"),
    )
    sized = written(sized, "mix-sizes")
    chosen = plan(sized, repeats)
    out = sized.join(chosen, _same_source(sized, chosen))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * rounds()).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, all columns unchanged.

    A null source is a source of its own, a null text has size 0 and is taken like any other of its
    source's hash; an empty table stays empty.
    """
    sized = docs.select(F.col("source").cast("string").alias("source"), words().alias("size"), hash_of("doc_id").alias("hash"))
    chosen = plan(written(sized, "mix-sizes"))
    rows = packed(docs, source=F.col("source").cast("string"), hash=hash_of("doc_id"))
    taken = rows.join(chosen, _same_source(rows, chosen)).filter(rounds() > 0)
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), rounds())).alias("round")), docs.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS h
  FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS s FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, ((rank - 1) % 3 + 1)::HUGEINT AS w FROM r),
f AS (
  SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS weights,
         sum(3 * s) OVER o - 3 * s AS before, sum(w) OVER o - w AS passed
  FROM w WINDOW o AS (ORDER BY s::DOUBLE * 3.0::DOUBLE / w, rank ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, 3 * s * (weights - passed) <= w * (total - before) AS filled FROM f),
g AS (
  SELECT *, w * (total - coalesce(sum(3 * s) FILTER (filled) OVER (), 0)) AS up, sum(w) FILTER (NOT filled) OVER () AS down FROM c),
t AS (
  SELECT source, s, CASE WHEN filled THEN (3 * s)::DOUBLE ELSE up::DOUBLE / down::DOUBLE END AS target,
         CASE WHEN s = 0 THEN 0 WHEN filled THEN 3 ELSE (up::HUGEINT // (down::HUGEINT * s)) END AS whole
  FROM g),
m AS (SELECT source, h, sum(size)::HUGEINT AS n FROM d GROUP BY source, h),
u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS after FROM m),
x AS (
  SELECT u.source, u.h, after < target - whole * s OR (
           after - n < target - whole * s AND after - (target - whole * s) <= (target - whole * s) - (after - n)) AS more
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source)
SELECT d.doc_id, d.size, t.s::BIGINT AS source_size, t.target,
       (d.size * (t.whole + CASE WHEN x.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""
