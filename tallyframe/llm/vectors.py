"""Exact top-k search by inner product over a vector-approximation file.

Components become floor(256 * x).  The approximation file holds one byte per component:
its cell among ``CELLS`` equal cells between the smallest and the largest component.  From
the cells' lower edges one product per query and vector gives a lower and an upper bound
of the score.  The scan keeps the vectors whose upper bound reaches the k-th lower bound.
Exact vectors are then read in two steps in order of the bounds: the k best bounds first,
then only those whose upper bound reaches the k-th exact score; after that the k-th result
is certain.

Queries and vectors meet in blocks: a task gets up to ``QUERIES_A_TASK`` blocks of queries
and ``BLOCKS_A_TASK`` blocks of approximations, so each approximation travels once for every
16,384 queries.  Of equal vectors only the k + 1 smallest different ids, and k rows of each,
can be results, so the rest is left out before the scan, wherever its rows are, without gathering them.

Defined cases: rows without id or vector, and vectors that hold null, NaN or infinity take
no part; only vectors of equal length meet; empty vectors score 0; rows that repeat an id
are results of their own, but never of a query of that id; repeated query rows are asked
once; scores are 64-bit, so vectors whose length times the square of their largest component
reaches 2**63 are an error; bounds are floating point, rounded outward where whole numbers no longer
fit (above 2**53), so they never rule out a result; an empty table or no query gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.tables import read, shuffle_partitions, written

SCALE, CELLS, K = 256, 64, 5
BLOCK, QUERY_BLOCK = 4096, 1024
BLOCKS_A_TASK, QUERIES_A_TASK = 16, 16


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and v (whole numbers) of the rows that take part; equal vectors share a key."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull()
        & F.col("x").isNotNull()
        & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    )
    whole = F.transform("x", lambda e: F.floor(e * SCALE).cast("long"))
    return rows.select("vec_id", F.size("x").alias("dim"), whole.alias("v"))


def blocks(rows: DataFrame, size: int, low: int, width: int) -> DataFrame:
    """Rows of up to ``size`` vectors of one length: dim, ids, cells (a byte each) and, for queries, exact components."""
    fields = [("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("cells", pa.binary()), ("exact", pa.binary())]
    schema = pa.schema(fields)

    def work(batches):
        def made(ids, values, dim):
            grid = np.asarray(values, np.int64).reshape(len(ids), dim)
            cells = ((grid - low) // width).astype(np.uint8)
            number = hash(tuple(ids[:1])) & 0x7FFFFFFF
            parts = [np.asarray(ids, "<i8").tobytes(), cells.tobytes(), grid.astype("<i8").tobytes() if size == QUERY_BLOCK else b""]
            return pa.RecordBatch.from_pylist(
                [{"dim": dim, "block": number, "ids": parts[0], "cells": parts[1], "exact": parts[2]}], schema
            )

        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for vec, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                ids, values = held.setdefault(len(v), ([], []))
                ids.append(vec)
                values.extend(v)
                if len(ids) == size:
                    yield made(*held.pop(len(v)), len(v))
        for dim, (ids, values) in held.items():
            yield made(ids, values, dim)

    return rows.select("vec_id", "v").mapInArrow(work, "dim int, block long, ids binary, cells binary, exact binary")


def _scan(left: pa.Table, right: pa.Table, low: int, width: int, k: int) -> pa.Table:
    """Vectors of some approximation blocks that may be among the k best of a block of queries."""
    out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2]
    blocks = left.to_pylist()
    for q in right.to_pylist():
        ids = np.frombuffer(q["ids"], "<i8")
        exact = np.frombuffer(q["exact"], "<i8").reshape(len(ids), q["dim"]).astype(float)
        size = np.abs(exact).sum(axis=1)
        most = size * max(abs(low), abs(low + CELLS * width))  # no sum on the way to a bound is larger
        slack = np.where(most < 2.0**52, 0.0, most * 2.0**-49 * (q["dim"] + 2))  # rounding of a product's sum
        gap = (width - 1) * size + 2 * slack  # upper less lower bound
        below = (width - 1) * np.minimum(exact, 0).sum(axis=1) - slack
        found: list[tuple[np.ndarray, ...]] = []
        best = np.full((len(ids), k), -np.inf)
        for c in blocks:
            if c["dim"] != q["dim"]:
                continue
            own = np.frombuffer(c["ids"], "<i8")
            edges = np.frombuffer(c["cells"], np.uint8).reshape(len(own), q["dim"]).astype(float) * width + low
            base = exact @ edges.T
            base[ids[:, None] == own[None, :]] = -np.inf
            best = -np.sort(-np.concatenate([best, -np.partition(-base, min(k, base.shape[1]) - 1, axis=1)[:, :k]], axis=1), axis=1)[:, :k]
            row, col = np.nonzero((base >= (best[:, k - 1] - gap)[:, None]) & (base > -np.inf))
            found.append((row, own[col], base[row, col]))
        for row, vec, base in found:
            keep = base >= (best[:, k - 1] - gap)[row]  # what later blocks have ruled out goes
            row, vec, base = row[keep], vec[keep], base[keep]
            out.append((ids[row], vec, base + below[row], base + below[row] + gap[row]))
    columns = [np.concatenate(c) for c in zip(*out)]
    return pa.table({n: pa.array(c) for n, c in zip(("query_id", "vec_id", "lower", "upper"), columns)})


def _without_copies(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` without those of equal vectors that can be no result: k + 1 ids stay, and k rows of each.

    Vectors travel only where more than k rows share a hash; partial ranks then leave few of
    them in every task before the exchange.
    """
    rows = rows.withColumn("same", F.xxhash64("v"))
    often = written(rows.groupBy(F.col("same").alias("of")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k).select("of"), "vector-copies")
    if often.isEmpty():
        return rows.drop("same")
    own, same = Window.partitionBy("v", "vec_id").orderBy("dim"), Window.partitionBy("v").orderBy("vec_id")
    many = rows.join(often, F.col("same") == F.col("of"), "left_semi").withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k)
    many = many.withColumn("n", F.dense_rank().over(same)).filter(F.col("n") <= k + 1).drop("n")
    return rows.join(often, F.col("same") == F.col("of"), "left_anti").unionByName(many).drop("same")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors for every query; ties go to the smaller id.

    Both tables have vec_id and embedding.
    """
    base = written(_without_copies(scaled(vectors), k), "vectors")
    asked = written(scaled(queries).distinct(), "vector-queries")
    ends = base.agg(
        F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"), F.max("dim").alias("dim"), F.count(F.lit(1)).alias("n")
    ).first()
    n_queries = asked.count()
    low, high = ends["low"] or 0, ends["high"] or 0
    if (ends["dim"] or 0) * max(abs(low), abs(high)) ** 2 >= 1 << 63:
        raise ValueError(f"scores of {ends['dim']} components up to {max(abs(low), abs(high))} / {SCALE} do not fit 64 bits")
    width = max(1, -(-(high - low + 1) // CELLS))
    spread = min(shuffle_partitions(vectors.sparkSession), -(-ends["n"] // BLOCK))
    tasks = max(1, spread, -(-ends["n"] // (BLOCK * BLOCKS_A_TASK)))
    groups = max(1, -(-n_queries // (QUERY_BLOCK * QUERIES_A_TASK)))
    cells = blocks(base, BLOCK, low, width).withColumn("task", F.pmod(F.xxhash64("block", "cells"), F.lit(tasks)).cast("int"))
    cells = written(cells, "vector-cells")
    dealt = asked.repartition(groups) if groups > 1 else asked.coalesce(1)
    wanted = written(blocks(dealt, QUERY_BLOCK, low, width), "vector-query-blocks")
    wanted = wanted.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    left = cells.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("task", "group")
    right = wanted.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).groupBy("task", "group")

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        return _scan(a, b, low, width, k)

    near = left.cogroup(right).applyInArrow(scan, "query_id long, vec_id long, lower double, upper double")
    near = written(near, "vector-near")
    order = Window.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id")
    first = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    sure = written(_scores(first, asked, base), "vector-first")
    kth = sure.groupBy("query_id").agg(F.min("score").cast("double").alias("least"), F.count(F.lit(1)).alias("n"))
    least = F.col("least") - F.abs("least") * 2.0**-52  # a 64-bit score may have been rounded up
    kth = kth.select("query_id", F.when(F.col("n") >= k, least).otherwise(F.lit(float("-inf"))).alias("least"))
    later = near.join(kth, "query_id").filter(F.col("upper") >= F.col("least"))
    later = later.join(sure.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_anti")
    both = sure.unionByName(_scores(later, asked, base))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _scores(pairs: DataFrame, asked: DataFrame, base: DataFrame) -> DataFrame:
    """query_id, vec_id and exact score of the named pairs."""
    mine = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    pairs = pairs.select("query_id", "vec_id").distinct()
    both = pairs.join(base.select("vec_id", "v"), "vec_id").join(mine, "query_id").filter(F.size("v") == F.size("q"))
    products = F.zip_with("v", "q", lambda a, b: a * b)
    return both.select("query_id", "vec_id", F.aggregate(products, F.lit(0).cast("long"), lambda s, p: s + p).alias("score"))


def op10_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
