"""Importance resampling towards a target distribution, with features counted once per distinct line.

Features are all runs of 1 to ``n`` consecutive words, put into ``buckets`` by their CRC-32.  A
separator line break ends a word, so a text's features are those of its lines and, from two
words on, the runs that cross a line break:

* **Lines.**  Texts are cut at line breaks and equal lines counted; the features of a
  distinct line are counted once and multiplied by the line's occurrences.
* **Across lines.**  Runs that cross a line break are read off every text apart and added.
  With ``n`` = 1 there are none, and that pass over the texts is left out.

Counts of all features by bucket, of the corpus and of the target, give a bucket's gain: the
logarithm of its smoothed share in the target over that in the corpus.  A document's weight
is the mean gain of its features, again put together from lines (a task keeps what it has
computed for up to ``KEPT_LINES`` short lines) and runs across them.  Weight plus Gumbel noise from a
hash of the document's id is its score; the highest scores are drawn, which is sampling without
replacement in proportion to the exponentials of the weights.

Scores are integers, so few that their histogram, at most some 200,000 rows whatever the
table's size, finds the cut; only documents at or above it are put in order, by range.

Defined cases: null and empty texts have no features, weight 0, and are not drawn; a null id
is hashed as the empty text and comes last among equal scores; rows of equal id are documents
of their own with equal noise, ordered by features and weight, equal rows in any order; empty tables of
documents give no rows, an empty target has no features; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.tables import in_batches, read, rows_of, whole_text, written
from tallyframe.llm.words import words_of
from tallyframe.operators.ordered import PIECE, in_pieces, numbered

N, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
KEPT_LINES, SHORT_LINE, KEPT_RUNS = 50_000, 400, 500_000
COUNTED = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("words", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


class Values(dict):
    """A value per run of words (joined by a space), worked out once for up to ``KEPT_RUNS`` runs."""

    def __init__(self, value: Callable[[int], int], buckets: int):
        super().__init__()
        self.value, self.buckets = value, buckets

    def __missing__(self, run: bytes) -> int:
        if len(self) >= KEPT_RUNS:
            self.clear()
        out = self[run] = self.value(zlib.crc32(run) % self.buckets)
        return out


def runs(words: list[bytes], n: int) -> Iterator[bytes]:
    """All runs of 1 to ``n`` consecutive words."""
    yield from words
    for long in range(2, n + 1):
        for i in range(len(words) - long + 1):
            yield b" ".join(words[i : i + long])


def crossing(lines: list[list[bytes]], n: int) -> Iterator[bytes]:
    """All runs of 2 to ``n`` consecutive words that lie in more than one line."""
    words, line = [], []
    for number, of in enumerate(lines):
        near = of if len(of) <= 2 * (n - 1) else [*of[: n - 1], None, *of[1 - n :]]  # no run that crosses holds an inner word
        words += near
        line += [number] * len(near)
    for i in range(len(words)):
        for end in range(i + 1, min(i + n, len(words))):
            if words[end] is None or words[i] is None:
                break
            if line[i] != line[end]:
                yield b" ".join(words[i : end + 1])


def raw_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _counted(batches: Iterator[tuple[bytes, int]], buckets: int, of: Callable[[bytes], Iterator[bytes]]) -> Iterator[pa.RecordBatch]:
    """Features by bucket of (text, times), summed in the task."""
    counts, bucket = [0] * buckets, Values(lambda b: b, buckets)
    for raw, times in batches:
        for b in map(bucket.__getitem__, of(raw)):
            counts[b] += times
    yield from in_batches([(b, n) for b, n in enumerate(counts) if n], COUNTED)


def bucket_counts(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts (column text) by bucket."""

    def of_lines(batches):
        pairs = ((raw_of(line), times) for line, times in rows_of(batches, "line", "times"))
        return _counted(pairs, buckets, lambda raw: runs(words_of(raw), n))

    def across(batches):
        pairs = ((raw_of(text), 1) for (text,) in rows_of(batches, "text"))
        return _counted(pairs, buckets, lambda raw: crossing([words_of(x) for x in raw.split(b"\n")], n))

    texts = texts.select(whole_text().alias("text"))
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    counted = lines.filter("line <> ''").mapInArrow(of_lines, "bucket int, n long")
    if n > 1:
        counted = counted.unionByName(texts.mapInArrow(across, "bucket int, n long"))
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """1000 times the log of a bucket's smoothed share in the target over that in the corpus, floored."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(corpus.tolist(), target.tolist())]


def noise(doc, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class Weigher:
    """Features, words and summed gain of texts; a line's are worked out once while it is kept."""

    def __init__(self, gain: list[int], n: int):
        self.n, self.gain, self.kept = n, Values(gain.__getitem__, len(gain)), {}

    def of_line(self, line: bytes) -> tuple[int, int, int]:
        found = self.kept.get(line)
        if found is None:
            words = words_of(line)
            features = words if self.n == 1 else list(runs(words, self.n))
            found = len(features), len(words), sum(map(self.gain.__getitem__, features))
            if len(line) <= SHORT_LINE:
                if len(self.kept) >= KEPT_LINES:
                    self.kept.clear()
                self.kept[line] = found
        return found

    def of(self, raw: bytes) -> tuple[int, int, int]:
        lines = raw.split(b"\n")
        features, words, total = (sum(x) for x in zip(*map(self.of_line, lines)))
        if self.n > 1:
            more = [self.gain[run] for run in crossing([words_of(x) for x in lines], self.n)]
            features, total = features + len(more), total + sum(more)
        return features, words, total


def scored(docs: DataFrame, gain: list[int], n: int = N, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, words, weight and score of every document (doc_id, text)."""

    def work(batches):
        weigher = Weigher(gain, n)

        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                features, words, total = weigher.of(raw_of(text))
                weight = total // features if features else 0
                yield doc, features, words, weight, weight + noise(doc, seed)

        yield from in_batches(rows(), SCORED)

    return docs.mapInArrow(work, "doc_id long, n_features long, words long, weight long, score long")


def drawn(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``rows`` of ``scored`` with the rank of those drawn, null for the others."""
    able = F.col("words") >= least_words
    # scores are at most some 200,000 different integers, as gains are logarithms of 64-bit counts
    counts = sorted(((r["score"], r["n"]) for r in rows.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    take, cut, above = percent * sum(n for _, n in counts) // 100, None, 0
    for score, n in counts:
        if above >= take:
            break
        cut, above = score, above + n
    upper = able & (F.col("score") >= cut) if cut is not None else F.lit(False)
    order = {"minus": -F.col("score"), "no_id": F.col("doc_id").isNull()}
    ordered = rows.filter(upper).withColumns(order)
    by = ["minus", "no_id", "doc_id", "n_features", "weight"]
    ordered = numbered(in_pieces(ordered, [], by), [], by, "place").drop(PIECE, *order)
    rank = F.when(F.col("place") <= take, F.col("place"))
    return ordered.select(*rows.columns, rank.alias("rank")).unionByName(rows.filter(~upper).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document its features, weight, score, and the rank in the draw towards the texts of ``target``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    rows = written(scored(docs, gain, n, seed), "scored")
    return drawn(rows, least_words, percent).drop("words")


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
