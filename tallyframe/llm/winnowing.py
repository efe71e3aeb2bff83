"""Winnowing fingerprints of documents, and how alike neighbouring documents are.

Every run of ``gram`` code points has a rolling hash.  From each window of ``window``
neighbouring hashes the smallest is chosen, the rightmost of equal ones, and kept with
its position: two texts that share gram + window - 1 code points in a row share a
fingerprint.  A text shorter than a gram has the hash of the whole text.

Long grams say little about short texts, so these are winnowed at finer scales as well
(``SCALES``): every text at 32 and 64, texts of less than 1,024 code points also at 12 and 24
(any 35 shared code points are found), of less than 256 also at 6 and 6 (any 11), of less
than 64 also at 3 and 2.  The scales depend on the text alone, and two texts are compared at
the finest that both have.

The next document by id is found without a global sort: bounds on the ids, of a fixed
number, cut the table into ranges; a range also gets the first document of the one that
follows.  An id that fills more than a range is cut by its texts' hashes, and equal rows
that fill more than one become one row with a number: all but the last of them are followed
by their own text.  Texts travel compressed, once.

Defined cases: a null text is empty; an empty text has no fingerprint, and two of them
are alike (1.0); null ids come first; documents of equal id are ordered by their text's
hash; a single document is its own successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.tables import in_batches, read, rows_of, shuffle_partitions, whole_text, written

GRAM, WINDOW = 32, 64
#: (texts of fewer code points, gram, window), finest last.
SCALES = ((1 << 62, GRAM, WINDOW), (1024, 12, 24), (256, 6, 6), (64, 3, 2))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: One bound and one id per range pass through the driver.
MOST_RANGES = 20_000
#: Ranges of a partition, so that ranges which fall together by their hash even out.
RANGES_A_PARTITION, COPIES = 4, 500
LOWEST = -(1 << 63)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base or of its inverse, modulo 2**64."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 14), BASE if kind == "up" else INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def gram_hashes(text: str, gram: int) -> np.ndarray:
    """The hash of every run of ``gram`` code points, all from one running sum."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(codes)
    if n <= gram:
        gram = n
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers("down", n), dtype=np.uint64)])
    return mixed((sums[gram:] - sums[:-gram]) * powers("up", n - gram + 1))


def smallest(values: np.ndarray, window: int) -> np.ndarray:
    """The minimum of every window, from running minima to both sides of block borders."""
    n = len(values)
    if n <= window:
        return values.min(keepdims=True)
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, window)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - window + 1], left[window - 1 : n])


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions that the windows choose, by position."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = gram_hashes(text, gram)
    low = np.uint64(0xFFFFFFFF)
    last = low - np.arange(len(hashes), dtype=np.uint64)  # of equal hashes the rightmost is smallest
    chosen = smallest((hashes & ~low) | last, window)
    at = np.unique((low - (chosen & low)).astype(np.int64))
    return hashes[at], at


def printed(hashes: np.ndarray, at: np.ndarray) -> str:
    return ",".join([f"{h >> 16:012x}@{p}" for h, p in zip(hashes.tolist(), at.tolist())])


def likeness(a: set, b: set) -> float:
    """Shared fingerprints as a share of all of both."""
    return len(a & b) / len(a | b) if a or b else 1.0


class Marked:
    """A document with its fingerprint: ``sets`` has one set of hashes for each of the text's scales."""

    __slots__ = ("doc", "text", "print", "sets")

    def __init__(self, doc, text: str, scales: tuple = SCALES):
        self.doc, self.text = doc, text
        chosen = [winnow(text, gram, window) for below, gram, window in scales if len(text) < below]
        self.print = ";".join([printed(*c) for c in chosen]) if text else ""
        self.sets = [set((hashes >> np.uint64(16)).tolist()) for hashes, _ in chosen]

    def like(self, other: Marked) -> float:
        at = min(len(self.sets), len(other.sets)) - 1
        return likeness(self.sets[at], other.sets[at])


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("times", pa.int64())]
)
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, times long"
)
FIRST = pa.schema([("range", pa.int32()), ("key", pa.int64()), ("tie", pa.int64())])
DEALT = pa.schema(
    [("range", pa.int32()), ("guest", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("times", pa.int64()), ("z", pa.binary())]
)


class Ranges:
    """Numbers of ranges over (id, text hash) that rise with both, from sorted cuts through the ids, repeated ones with cuts through the hashes."""

    def __init__(self, cuts: list[int], inner: dict[int, list[int]]):
        self.bounds, self.inner, self.first = sorted(set(cuts)), inner, [0]
        for bound in self.bounds:
            self.first.append(self.first[-1] + 1 + (len(inner[bound]) + 1 if bound in inner else 0))

    def of(self, key: int, tie: int) -> int:
        at = bisect_left(self.bounds, key)
        if at < len(self.bounds) and self.bounds[at] == key and key in self.inner:
            return self.first[at] + 1 + bisect_left(self.inner[key], tie)
        return self.first[at]


def _cuts(rows: DataFrame, parts: int) -> tuple[Ranges, list[tuple[int, int]]]:
    """The ranges, and the (id, hash) of equal rows that fill more than one range."""
    shares = [(i + 1) / parts for i in range(parts - 1)]
    cuts = rows.agg(F.percentile_approx("key", F.lit(shares), F.lit(20 * parts)).alias("at")).first()["at"] or []
    often = {key: n for key in set(cuts) if (n := cuts.count(key)) > 1}
    inner, hot = {}, []
    for size in sorted({n.bit_length() for n in often.values()}):
        # at most as many cuts through hashes as there are cuts through ids
        mine = [key for key, n in often.items() if n.bit_length() == size]
        inside = [(i + 1) / (1 << size) for i in range((1 << size) - 1)]
        found = rows.filter(F.col("key").isin(mine)).groupBy("key").agg(F.percentile_approx("tie", F.lit(inside), F.lit(40 << size)).alias("at"))
        for row in found.collect():
            inner[row["key"]] = sorted(set(row["at"]))
            hot += [(row["key"], tie) for tie in inner[row["key"]] if row["at"].count(tie) > 1]
    return Ranges(cuts, inner), hot


def _collapsed(rows: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with ``times``: equal rows of the hot (id, hash) pairs are one row."""
    one = F.lit(1).cast("long").alias("times")
    if not hot:
        return rows.select("*", one)
    # at most one pair a range
    pairs = F.broadcast(rows.sparkSession.createDataFrame(hot, "key long, tie long"))
    many = rows.join(pairs, ["key", "tie"], "left_semi").groupBy("doc_id", "key", "tie", "text").agg(F.count(F.lit(1)).alias("times"))
    return rows.join(pairs, ["key", "tie"], "left_anti").select("*", one).unionByName(many.select(*rows.columns, "times"))


def fingerprints(docs: DataFrame, scales: tuple = SCALES) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and likeness to that and to the next document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("key"), F.xxhash64("text").alias("tie"))
    parts = max(8, shuffle_partitions(spark))
    ranges, hot = _cuts(docs, min(MOST_RANGES, parts * RANGES_A_PARTITION))
    within = bool(ranges.inner)

    def least(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            if within:
                ties = batch.column("tie").to_numpy(zero_copy_only=False)
                of: dict[int, tuple[int, int]] = {}
                for place in sorted(zip(keys.tolist(), ties.tolist()), reverse=True):
                    of[ranges.of(*place)] = place
            else:
                number, at = np.unique(np.searchsorted(np.array(ranges.bounds, np.int64), keys), return_inverse=True)
                low = np.full(len(number), np.iinfo(np.int64).max)
                np.minimum.at(low, at, keys)
                of = {ranges.first[n]: (key, 0) for n, key in zip(number.tolist(), low.tolist())}
            yield from in_batches(((n, *place) for n, place in of.items()), FIRST)

    # one row per range comes to the driver; the hashes are read only where an id has several ranges
    places = docs.select("key", "tie" if within else F.lit(0).cast("long").alias("tie")).mapInArrow(least, "range int, key long, tie long")
    found = places.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("least")).collect()
    firsts = sorted((r["range"], tuple(r["least"])) for r in found)
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # the first one follows the last

    def deal(batches):
        squeeze = zstandard.ZstdCompressor(level=1)

        def rows():
            for doc, text, key, tie, times in rows_of(batches, "doc_id", "text", "key", "tie", "times"):
                z = squeeze.compress(text.encode("utf-8", "surrogatepass"))
                yield ranges.of(key, tie), False, doc, tie, times, z
                place = (key, tie if within else 0)
                if place in before:
                    yield before[place], True, doc, tie, times, z

        yield from in_batches(rows(), DEALT)

    def compare(batches):
        unsqueeze = zstandard.ZstdDecompressor()

        def result(this: Marked, after: Marked) -> tuple:
            n = len(this.text)
            edited = this.text[: n - n // 4] + after.text[: n // 4]
            other = Marked(None, edited, scales)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return this.doc, n, sha, this.print, other.print, this.like(other), this.like(after)

        def rows():
            held, where = None, None
            for number, guest, doc, times, z in rows_of(batches, "range", "guest", "doc_id", "times", "z"):
                if guest and held is None:
                    continue  # a further document that shares the first one's place
                now = Marked(doc, unsqueeze.decompress(z).decode("utf-8", "surrogatepass"), scales)
                if held is not None and where == number:
                    yield *result(held, now), 1
                if times > 1 and not guest:
                    yield *result(now, now), times - 1
                held, where = None if guest else now, number

        yield from in_batches(rows(), SCHEMA)

    dealt = _collapsed(docs, hot).mapInArrow(deal, "range int, guest boolean, doc_id long, tie long, times long, z binary")
    order = ["range", "guest", F.col("doc_id").asc_nulls_first(), "tie"]
    out = dealt.repartition(parts, "range").sortWithinPartitions(*order).mapInArrow(compare, RESULT)
    if hot:  # equal rows again, dealt out a few hundred at a time
        out = written(out, "fingerprints")
        many = out.filter("times > 1").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES))))
        many = many.repartition(parts).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("times") - F.col("lot") * COPIES, F.lit(COPIES)))))
        out = out.filter("times = 1").unionByName(many.select(out.columns))
    return out.drop("times")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
