"""Ranked lexical search: short lists are summed first, long lists are skipped through by bounds.

Documents are searched in shards, each a run of rows of the written index, so that no posting
list is larger than a shard.  Within a shard a query works in two ways at once:

* **Term at a time**: the lists of terms in less than one of ``SHORT`` documents are added up
  into accumulators, one per document.
* **Document at a time**: the accumulators then count as one list beside the long ones.  Every
  list knows its largest score in each block of ``BLOCK`` documents.  Blocks whose largest
  scores together stay below the kth score so far are skipped; in the others the long lists
  are looked up from the strongest to the weakest, and a document leaves as soon as what it
  has and what the remaining lists can give in its block stay below that score.

A document's score for a term is the term's weight times a saturated count (``impacts``), all
in 64-bit integers.  Numbers of documents per term, of documents and of terms count all
documents.  The index of a document holds the terms of the queries only.

Queries come in blocks of about ``QUERY_TERMS`` terms; a block's terms travel to the tasks,
and every block reads all documents.  A shard returns the k best of each query, and the best
of all shards are found in two steps, so that no task gets the results of all shards.

Defined cases: null and empty texts have no terms; documents without a term count neither as
documents nor as results; every row of the queries is ranked by itself, also of equal or null
id; a query without terms, or whose terms no document has, gives no rows; rows of equal
document id are documents of their own, null ids come last among equal scores; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.tables import in_batches, read, rows_of, whole_text, written
from tallyframe.llm.words import words_of

TOP, SHORT, BLOCK, CHUNK = 20, 16, 128, 32
SHARD_DOCS, SHARD_POSTINGS, QUERY_TERMS, SALTS = 65_536, 2_000_000, 200_000, 32
INDEX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
COUNTED = pa.schema([("term", pa.int32()), ("docs", pa.int64())])
FOUND = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def weight(docs: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * with_term + 1)))


def lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The length term of documents of ``n`` terms: 100 at the mean length."""
    if len(n) and 25 * int(n.max()) * docs >= 1 << 63:
        return np.array([75 + 25 * int(x) * docs // terms for x in n], np.int64)
    return 75 + 25 * n * docs // max(1, terms)


def impacts(weights: np.ndarray, counts: np.ndarray, length: np.ndarray) -> np.ndarray:
    return weights * (1_000_000_000 * counts // (1000 * counts + 12 * length))


class Long:
    """A long list: its documents and scores, and the largest score of each block."""

    __slots__ = ("docs", "score", "most", "kth")

    def __init__(self, docs: np.ndarray, score: np.ndarray, blocks: int, k: int):
        self.docs, self.score = docs, score
        self.most = np.zeros(blocks, np.int64)
        np.maximum.at(self.most, docs // BLOCK, score)
        self.kth = int(np.partition(score, -k)[-k]) if len(score) >= k else 0


class Shard:
    """Posting lists of a run of documents, which are numbered by ascending id, null ids last."""

    def __init__(self, ids: list, n: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, docs: int, total: int):
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
        self.ids = [ids[i] for i in order]
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        doc = np.repeat(number, sizes)
        by = np.lexsort((doc, terms))
        terms, counts, self.doc = terms[by], counts[by], doc[by]
        self.score = impacts(weights[terms], counts, lengths(n, docs, total)[order][self.doc])
        self.start = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.blocks = -(-len(ids) // BLOCK)
        self.long: dict[tuple[int, int], Long] = {}

    def search(self, query: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """(document number, score) of the k best for (term, times), best first, equal scores by ascending number."""
        total, lists = len(self.ids), []
        sums = np.zeros(total, np.int64)
        for term, times in query:
            a, b = self.start[term], self.start[term + 1]
            if (b - a) * SHORT < total:
                sums[self.doc[a:b]] += times * self.score[a:b]  # a document is in a list once
            else:
                if (term, k) not in self.long:
                    self.long[term, k] = Long(self.doc[a:b], self.score[a:b], self.blocks, k)
                lists.append((self.long[term, k], times))
        grid = np.zeros(self.blocks * BLOCK, np.int64)
        grid[:total] = sums
        lists.sort(key=lambda x: -x[1] * int(x[0].most.max()))
        after = np.zeros((len(lists) + 1, self.blocks), np.int64)  # what the lists from here on can give in a block
        for i in range(len(lists) - 1, -1, -1):
            after[i] = after[i + 1] + lists[i][1] * lists[i][0].most
        bound = grid.reshape(-1, BLOCK).max(axis=1) + after[0]
        # k documents have at least this much from the accumulators, or from one list
        least = max([1, *(times * x.kth for x, times in lists), int(np.partition(sums, -k)[-k]) if total >= k else 0])
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        left = np.flatnonzero(bound >= least)
        while len(left):
            now, left = left[:CHUNK], left[CHUNK:]
            docs = (now[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            docs = docs[docs < total]
            have = sums[docs]
            for i, (x, times) in enumerate(lists):
                alive = have + after[i][docs // BLOCK] >= least
                docs, have = docs[alive], have[alive]
                if not len(docs):
                    break
                at = np.searchsorted(x.docs, docs)
                at[at == len(x.docs)] = 0
                have = have + np.where(x.docs[at] == docs, times * x.score[at], 0)
            alive = have >= least
            best, scores = np.concatenate([best, docs[alive]]), np.concatenate([scores, have[alive]])
            if len(best) >= k:
                chosen = np.lexsort((best, -scores))[:k]
                best, scores = best[chosen], scores[chosen]
                if scores[-1] > least:
                    least = int(scores[-1])
                    left = left[bound[left] >= least]
        chosen = np.lexsort((best, -scores))[:k]
        return list(zip(best[chosen].tolist(), scores[chosen].tolist()))


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document its number of terms, and the terms of ``vocabulary`` with their counts."""

    def work(batches):
        number = vocabulary.get

        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                words = words_of(text.encode("utf-8", "surrogatepass"))
                if words:
                    held = [(t, c) for w, c in Counter(words).items() if (t := number(w)) is not None]
                    yield doc, len(words), [t for t, _ in held], [c for _, c in held]

        yield from _indexed(rows())

    return docs.mapInArrow(work, "doc_id long, n long, terms array<int>, counts array<long>")


def _indexed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of about 500,000 postings."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + 100
        if size > 500_000:
            yield from in_batches(held, INDEX, size=len(held))
            held, size = [], 0
    yield from in_batches(held, INDEX, size=max(1, len(held)))


def _documents_with(index: DataFrame, terms: int) -> np.ndarray:
    """The number of documents that hold each of ``terms`` terms, summed per task before they meet."""

    def work(batches):
        of = np.zeros(terms, np.int64)
        for batch in batches:
            of += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=terms)
        at = np.flatnonzero(of)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(of[at], pa.int64())], schema=COUNTED)

    counted = index.select("terms").mapInArrow(work, "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    out = np.zeros(terms, np.int64)
    for row in counted.collect():  # one row per term of a block of queries
        out[row["term"]] = row["docs"]
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """ids, numbers of terms, postings' terms and counts and the postings of each document, a shard at a time."""
    held, docs, postings = [], 0, 0

    def joined():
        flat = lambda name: np.concatenate([b.column(name).flatten().to_numpy(zero_copy_only=False) for b in held])
        sizes = np.concatenate([np.diff(b.column("terms").offsets.to_numpy()) for b in held])
        n = np.concatenate([b.column("n").to_numpy() for b in held])
        return [i for b in held for i in b.column("doc_id").to_pylist()], n, flat("terms"), flat("counts"), sizes

    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            held.append(part)
            docs += part.num_rows
            postings += len(part.column("terms").flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield joined()
                held, docs, postings = [], 0, 0
    if docs:
        yield joined()


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _ranked_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame | None:
    """item_id, rank, doc_id, score for items (id, text)."""
    texts = [Counter(words_of(text.encode("utf-8", "surrogatepass"))) for _, text in items]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    if not vocabulary:
        return None
    queries = [[(vocabulary[w], c) for w, c in t.items()] for t in texts]
    index = written(_index(docs, vocabulary), "index")
    of_all = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    total, terms = of_all["docs"], of_all["terms"] or 0
    weights = np.array([weight(total, int(d)) for d in _documents_with(index, len(vocabulary))], np.int64)

    def work(batches):
        def rows():
            for ids, n, of, counts, sizes in _shards(batches):
                shard = Shard(ids, n, of, counts, sizes, weights, total, terms)
                for number, query in enumerate(queries):
                    for doc, score in shard.search(query, k):
                        yield number, shard.ids[doc], score

        yield from in_batches(rows(), FOUND)

    found = index.mapInArrow(work, "query int, doc_id long, score long").withColumn("salt", F.spark_partition_id() % SALTS)
    found = _best(_best(found, ["query", "salt"], k).drop("rank"), ["query"], k)
    ids = docs.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "query int, item_id long")
    return found.join(ids, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, query_terms: int = QUERY_TERMS) -> DataFrame:
    """The ``k`` best documents for every row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    size = items.agg(F.sum(F.length("text") / 2).alias("n")).first()["n"] or 0  # a term and its separator have two characters at least
    blocks = max(1, math.ceil(size / query_terms))
    items = written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "queries")
    out = None
    for block in range(blocks):
        rows = items.filter(F.col("block") == block).select("item_id", "text").collect()  # about query_terms terms
        part = _ranked_block(docs, [(r["item_id"], r["text"]) for r in rows], k) if rows else None
        out = part if out is None else out if part is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
OP11_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
docs AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM words WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
items AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS w FROM benchmark),
asked AS (SELECT q, item_id, t, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(w) AS t FROM items) GROUP BY ALL),
postings AS (
  SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM docs)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total GROUP BY t),
scores AS (
  SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN postings USING (t) JOIN weights USING (t), total GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranks WHERE rank <= {TOP}
"""
