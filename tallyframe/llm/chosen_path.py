"""Join of documents whose word n-grams have Jaccard similarity of at least a threshold.

Chosen-path join.  A set of n-grams is embedded as ``SIGNATURE`` min-hash tokens.  In every
one of ``RUNS`` runs a set follows a few of its tokens, chosen by a hash that all sets
share, so that similar sets choose the same ones: a pair at the threshold shares more than
one path a run on average.  A bucket of more than ``SMALL`` sets on one path is split again
on further tokens, up to ``DEPTH`` times; smaller ones (and what is left at the end, in
pairs of blocks) are compared by their signatures.  The number of runs is what the target
recall needs at the greatest depth.

Pairs whose signatures agree in ``SIMILARITY`` less ``MARGIN`` or more only join sets into
groups.  What is left in buckets of more than ``BUCKET_BLOCK`` sets is not compared pair by
pair: every set is compared with about ``PIVOTS`` pivots of its bucket, and the sets close to
one (its ball) are joined through it.  Disagreement of signatures is a metric, so by the
triangle inequality no near pair is lost if two pivots, or a pivot and a set outside all
balls, are joined up to the distance that such a pair allows; only sets outside all balls are
compared with each other.

Then every group is compared exactly, all sets against all, so that each pair is looked at
once: this gives every set's number of links, and the classes.  A group of more than
``GROUP_BLOCK`` sets is compared in pairs of blocks, as differences: of each set only the
n-grams travel that it has and the group's first set has not, or the other way round.  Two
sets' overlap follows from these and the sizes, so what is sent several times is small for
near copies however long they are.  No pair is ever a row: tasks return a row per set and
block with its links and the smallest set it is connected to.

Equal sets are one set with a weight before anything else.  Texts travel compressed, once,
and only those of groups of two or more are used.

Defined cases: words are runs without ASCII white space, in lower case; a text of fewer
than five words has one n-gram of all of them; a null text or one without words has no
n-gram, is a class of its own and has no links; repeated rows are linked to each other;
null ids are classes like others, and a class is named by its smallest id, null if it has
none; an empty table gives no rows; other columns are ignored, in the pipeline they are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tallyframe.llm.components import components
from tallyframe.llm.tables import cells_of, in_batches, packed, read, rows_of, unpacked, whole_text, written
from tallyframe.llm.winnowing import mixed, powers

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
SIGNATURE, DEPTH, SMALL = 128, 3, 256
#: Signatures of a pair at the threshold agree less often with a chance below 1e-6.
MARGIN = 0.17
BUCKET_BLOCK, GROUP_BLOCK, DELTA_BLOCK = 2048, 512, 2048
#: Compressed texts of a block of a large group, which bounds a task's differences.
DELTA_BYTES = 16_000_000
PIVOTS, BALL = 32, 0.2
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
STEP = np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def runs_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold shares a path of full depth with this probability."""
    mean, lives = similarity / (similarity - MARGIN / 2), 1.0
    for _ in range(depth):
        lives = 1 - math.exp(-mean * lives)
    return math.ceil(math.log(1 - recall) / math.log(1 - lives))


def ngrams(text: str, width: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different runs of ``width`` words."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate([[False], ~SPACE[raw], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turns[::2], turns[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers("down", len(raw)))])
    words = mixed((sums[end] - sums[start]) * powers("up", len(raw))[start] + (end - start).astype(np.uint64) * STEP)
    width = min(width, len(words))
    found = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        found = found * STEP + words[k : len(words) - width + 1 + k]
    return np.unique(mixed(found + np.uint64(width)))


def signature(grams: np.ndarray) -> np.ndarray:
    """Min-hash tokens of a set that is not empty."""
    out = np.empty(SIGNATURE, np.uint32)
    step = max(1, min(SIGNATURE, 262_144 // len(grams) or 1))
    for i in range(0, SIGNATURE, step):
        values = grams[None, :] * FACTORS[i : i + step, None] + SHIFTS[i : i + step, None]
        out[i : i + step] = (values.min(axis=1) >> np.uint64(32)).astype(np.uint32)
    return out


def tokens(signatures: np.ndarray) -> np.ndarray:
    """Signatures (rows) as 64-bit tokens that name place and value."""
    place = np.arange(SIGNATURE, dtype=np.uint64) << np.uint64(32)
    return mixed((signatures.astype(np.uint64) | place) * STEP + np.uint64(1))


def chosen(token: np.ndarray, path: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``token`` that go on from their path, and the paths they reach (one row a step)."""
    draw = mixed((token ^ path[:, None]) * STEP)
    row, col = np.nonzero(draw < np.uint64(int(min(1.0, rate) * (2**64 - 2**11))))
    return row, mixed(draw[row, col] + path[row] * STEP)


def _rate(similarity: float) -> float:
    return 1 / ((similarity - MARGIN / 2) * SIGNATURE)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, tie (of the text), key of the set (null without words), its size and signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("key", pa.binary()), ("signature", pa.binary())])

    def work(batches):
        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                grams = ngrams(text, width)
                tie = tie_of(text)
                if len(grams):
                    yield doc, tie, xxhash.xxh3_128_digest(grams.tobytes()), signature(grams).tobytes()
                else:
                    yield doc, tie, None, None

        yield from in_batches(rows(), schema)

    return docs.mapInArrow(work, "doc_id long, tie long, key binary, signature binary")


def tie_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _asked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def _first_paths(sets: DataFrame, runs: int, rate: float) -> DataFrame:
    """(path, key) of the first step of every run."""
    schema = pa.schema([("path", pa.int64()), ("key", pa.binary())])

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys, token = part.column("key"), tokens(_signatures(part))
                for run in range(runs):
                    seed = np.full(len(token), mixed(np.uint64([run + 1]) * STEP)[0])
                    row, path = chosen(token, seed, rate)
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), keys.take(pa.array(row))], schema=schema)

    return sets.select("key", "signature").mapInArrow(work, "path long, key binary")


def _next_paths(rows: DataFrame, rate: float) -> DataFrame:
    """(path, key) one step on from (path, key, signature)."""
    schema = pa.schema([("path", pa.int64()), ("key", pa.binary())])

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                before = part.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
                row, path = chosen(tokens(_signatures(part)), before, rate)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), part.column("key").take(pa.array(row))], schema=schema)

    return rows.select("path", "key", "signature").mapInArrow(work, "path long, key binary")


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    data = b"".join(batch.column("signature").to_pylist())
    return np.frombuffer(data, np.uint32).reshape(-1, SIGNATURE)


def _leaves(sets: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(path, key, n) of the buckets to compare; n is the bucket's size."""
    rate = _rate(similarity)
    rows, leaves = _first_paths(sets, runs_for(recall, similarity), rate), None
    for depth in range(1, DEPTH + 1):
        rows = written(rows, "paths")
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = written(rows.join(sizes, "path"), "paths-sized")
        small = sized if depth == DEPTH else sized.filter(F.col("n") <= SMALL)
        leaves = small if leaves is None else leaves.unionByName(small)
        if depth < DEPTH:
            large = sized.filter(F.col("n") > SMALL)
            rows = _next_paths(large.join(sets.select("key", "signature"), "key"), rate)
    return leaves


def in_blocks(df: DataFrame, group: str, size: Column, key: str, block: int) -> DataFrame:
    """``df`` with ``task`` and ``side``: rows of a large group go to every pair of blocks that holds theirs.

    A group of up to ``block`` rows is one task; side tells the first block (0) from the second (1).
    """
    blocks = F.ceil(size / block).cast("int")
    mine = F.pmod(F.xxhash64(F.col(key)), blocks).cast("int")
    other = F.sequence(F.lit(0), blocks - 1)
    df = df.withColumn("__n", blocks).withColumn("__mine", mine).withColumn("__other", F.explode(other))
    low, high = F.least("__mine", "__other"), F.greatest("__mine", "__other")
    side = F.when(F.col("__mine") <= F.col("__other"), 0).otherwise(1)
    return df.withColumn("task", F.xxhash64(F.col(group), low, high)).withColumn("side", side.cast("int")).withColumn(
        "whole", F.col("__mine") == F.col("__other")
    ).drop("__n", "__mine", "__other")


def by_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one task after another, from batches sorted by ``task``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column("task").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column("task")[0].as_py() != task[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def linked_groups(marks: np.ndarray, least: int) -> np.ndarray:
    """The first row that each row is connected to by pairs of signatures that agree in ``least`` places.

    Every row that is reached is compared with the rows not reached yet, so a bucket of
    near copies takes one look at each.
    """
    label = np.full(len(marks), -1)
    open_rows = np.arange(len(marks))
    for start in range(len(marks)):
        if label[start] >= 0:
            continue
        label[start] = start
        open_rows = open_rows[label[open_rows] < 0]
        front = [start]
        while front and len(open_rows):
            at = front.pop()
            near = (marks[open_rows] == marks[at]).sum(axis=1) >= least
            label[open_rows[near]] = start
            front.extend(open_rows[near].tolist())
            open_rows = open_rows[~near]
    return label


def _least(similarity: float) -> int:
    """Places in which the signatures of a pair at the threshold agree, but for a small chance."""
    return math.ceil((similarity - MARGIN) * SIGNATURE)


def _marks(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("mark").to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def _pivot_edges(large: DataFrame, mark: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of large buckets (path, key, n) through pivots; and with their path, sets (a) that lie in no pivot's ball."""
    blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    draw = F.pmod(F.xxhash64("key", "path", F.lit("pivot")), F.lit(1 << 40)) / float(1 << 40)
    rows = large.join(mark, "key").select("path", "key", "mark", blocks.alias("blocks"), (draw < PIVOTS / F.col("n")).alias("pivot"))
    task = lambda block: F.xxhash64("path", block).alias("task")
    members = rows.select(task(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "path", "key", "mark", F.lit(False).alias("pivot"))
    pivots = rows.filter("pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = members.unionByName(pivots.select(task(F.col("block")), "path", "key", "mark", "pivot"))
    near, ball = SIGNATURE - _least(similarity), int(BALL * SIGNATURE)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("path", pa.int64())])

    def work(batches):
        def found():
            for table in by_task(batches):
                table = table.sort_by("key")
                marks, keys, path = _marks(table), table.column("key").to_pylist(), table.column("path")[0].as_py()
                pivot = table.column("pivot").to_numpy()
                middle, at = marks[pivot], np.flatnonzero(pivot).tolist()
                for i, root in enumerate(linked_groups(middle, SIGNATURE - near - 2 * ball)):
                    if i != root:
                        yield keys[at[i]], keys[at[root]], None
                rest = np.flatnonzero(~pivot)
                far = np.empty((len(rest), len(at)), np.int64)
                for k, m in enumerate(middle):
                    far[:, k] = (marks[rest] != m).sum(axis=1)
                inside = (far <= ball).any(axis=1) if at else np.zeros(len(rest), bool)
                for i in np.flatnonzero(inside).tolist():
                    yield keys[rest[i]], keys[at[int(far[i].argmin())]], None
                for i in np.flatnonzero(~inside).tolist():
                    yield keys[rest[i]], None, path
                    for k in np.flatnonzero(far[i] <= near + ball).tolist():
                        yield keys[rest[i]], keys[at[k]], None

        yield from in_batches(found(), schema)

    return both.repartition("task").sortWithinPartitions("task").mapInArrow(work, "a binary, b binary, path long")


def _candidate_edges(leaves: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect the sets of every bucket whose signatures are near.

    A group's edges go to its smallest set, so the buckets of one group mostly repeat them.
    """
    least, mark = _least(similarity), sets.select("key", "mark")
    leaves = written(leaves, "leaves")
    large = leaves.filter(F.col("n") > BUCKET_BLOCK)
    compared, through = leaves.filter(F.col("n") <= BUCKET_BLOCK), None
    if not large.isEmpty():
        through = written(_pivot_edges(large, mark, similarity), "pivot-edges")
        outside = through.filter("path is not null").select("path", F.col("a").alias("key"))
        sizes = outside.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        compared = compared.unionByName(outside.join(sizes, "path").select(compared.columns))
    rows = in_blocks(compared, "path", F.col("n"), "key", BUCKET_BLOCK).join(mark, "key").select("task", "key", "mark")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def work(batches):
        def edges():
            for table in by_task(batches):
                if table.num_rows < 2:
                    continue
                table = table.sort_by("key")
                keys = table.column("key").to_pylist()
                for i, root in enumerate(linked_groups(_marks(table), least)):
                    if i != root:
                        yield keys[i], keys[root]

        yield from in_batches(edges(), schema)

    edges = rows.repartition("task").sortWithinPartitions("task").mapInArrow(work, "a binary, b binary")
    return edges if through is None else edges.unionByName(through.filter("path is null").select("a", "b"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, from products of shared-token columns."""
    m = len(sets)
    if m <= 6:
        out = np.zeros((m, m), np.float32)
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[token] > 1
    owner, token = owner[shared], column[token[shared]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out, width = np.zeros((m, m), np.float32), max(256, 4_000_000 // m)
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [low, low + width])
        grid = np.zeros((m, width), np.float32)
        grid[owner[a:b], token[a:b] - low] = 1
        out += grid @ grid.T
    return out


def links_in(sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray, whole: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Per set the weight of its links and the first set it is connected to, in one pair of blocks."""
    size = np.array([len(s) for s in sets], np.int64)
    return links_of(overlaps(sets), 0, np.zeros(len(sets), np.int64), size, weights, side, whole, similarity)


def links_of(
    shared: np.ndarray, base: int, lost: np.ndarray, size: np.ndarray, weights: np.ndarray, side: np.ndarray, whole: bool, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """``links_in`` from the overlaps of differences to a base set of ``base`` n-grams, of which each set has ``lost`` some."""
    m = len(size)
    near = np.empty((m, m), bool)
    tiles = [slice(a, a + 256) for a in range(0, m, 256)]
    for t in tiles:
        both = shared[t] + (base - lost[t, None] - lost[None, :]).astype(np.float64)
        near[t] = both >= similarity * (size[t, None] + size[None, :] - both) - 1e-9
        if not whole:
            near[t] &= side[t, None] != side[None, :]
    np.fill_diagonal(near, False)
    root = np.arange(m)
    while True:
        low = np.concatenate([np.where(near[t], root[None, :], m).min(axis=1, initial=m) for t in tiles])
        low = np.minimum(root, low)
        low = low[low]
        if (low == root).all():
            return np.concatenate([near[t] @ weights for t in tiles]), root
        root = low


LINKS = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


def _linked(keys: list[bytes], links: np.ndarray, root: np.ndarray) -> Iterator[tuple]:
    for k, n, r in zip(keys, links.tolist(), root.tolist()):
        if n:
            yield k, n, keys[r]


def _large_links(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """(key, links, root) of groups compared in pairs of blocks, from differences to the group's first set."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("z")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / DELTA_BLOCK), F.ceil(F.col("bytes") / DELTA_BYTES)).cast("int").alias("blocks")
    rows = rows.select("key", "label", "weight", "z").join(sizes.select("label", blocks), "label")
    task = lambda block: F.xxhash64("label", block).alias("task")
    members = rows.select(task(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "key", "label", "blocks", "weight", "z", F.lit(False).alias("base"))
    first = rows.filter(F.col("key") == F.col("label")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = members.unionByName(first.select(task(F.col("block")), "key", "label", "blocks", "weight", "z", F.lit(True).alias("base")))
    schema = pa.schema(
        [("key", pa.binary()), ("label", pa.binary()), ("blocks", pa.int32()), ("weight", pa.int64()), ("of", pa.int64()), ("size", pa.int64()),
         ("lost", pa.int64()), ("apart", pa.binary())]
    )

    def differ(batches):
        def found():
            expand, task, base, seen = zstandard.ZstdDecompressor(), None, None, set()
            for at, key, label, blocks, weight, z, first in rows_of(batches, "task", "key", "label", "blocks", "weight", "z", "base"):
                grams = ngrams(expand.decompress(z).decode("utf-8", "surrogatepass"), width)
                if first:
                    task, base, seen = at, grams, set()
                elif at == task and key not in seen:  # a repeated row gives its set twice
                    seen.add(key)
                    apart = np.setxor1d(grams, base, assume_unique=True)
                    lost = (len(apart) - len(grams) + len(base)) // 2
                    yield key, label, blocks, weight, len(base), len(grams), lost, apart.tobytes()

        yield from in_batches(found(), schema)

    kinds = "key binary, label binary, blocks int, weight long, of long, size long, lost long, apart binary"
    apart = both.repartition("task").sortWithinPartitions("task", F.desc("base")).mapInArrow(differ, kinds)
    apart = written(apart, "differences")
    pairs = in_blocks(apart, "label", F.col("blocks"), "key", 1)

    def work(batches):
        def found():
            for table in by_task(batches):
                table = table.sort_by("key")
                sets = [np.frombuffer(x, np.uint64) for x in table.column("apart").to_pylist()]
                of = lambda name: table.column(name).to_numpy()
                links, root = links_of(
                    overlaps(sets), table.column("of")[0].as_py(), of("lost"), of("size"), of("weight"), of("side"), table.column("whole")[0].as_py(), similarity
                )
                yield from _linked(table.column("key").to_pylist(), links, root)

        yield from in_batches(found(), LINKS)

    return pairs.repartition("task").sortWithinPartitions("task").mapInArrow(work, "key binary, links long, root binary")


def _exact_links(docs: DataFrame, sets: DataFrame, groups: DataFrame, width: int, similarity: float) -> DataFrame:
    """(key, links, root) per set and task: all pairs of every group compared exactly."""
    sizes = written(groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    wanted = groups.join(sizes, "label").join(sets.select("key", "weight", "rep"), "key")
    wanted = wanted.select("key", "label", "n", "weight", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tie").alias("rep_tie"))
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("z", pa.binary())])

    def squeeze(batches):
        small = zstandard.ZstdCompressor(level=1)
        rows = ((doc, tie_of(text), small.compress(text.encode("utf-8", "surrogatepass"))) for doc, text in rows_of(batches, "doc_id", "text"))
        yield from in_batches(rows, schema)

    texts = docs.mapInArrow(squeeze, "doc_id long, tie long, z binary")
    same = texts["doc_id"].eqNullSafe(wanted["rep_id"]) & (texts["tie"] == wanted["rep_tie"])
    rows = texts.join(wanted, same).select("key", "label", "n", "weight", "z")
    large = not sizes.filter(F.col("n") > GROUP_BLOCK).isEmpty()
    if large:
        rows = written(rows, "group-texts")
    small = rows.filter(F.col("n") <= GROUP_BLOCK).select(F.xxhash64("label").alias("task"), "key", "weight", "z")

    def work(batches):
        def found():
            expand = zstandard.ZstdDecompressor()
            for table in by_task(batches):
                once = {k: i for i, k in enumerate(table.column("key").to_pylist())}  # a repeated row gives its set twice
                keys = sorted(once)
                table = table.take([once[k] for k in keys])
                sets = [ngrams(expand.decompress(z.as_py()).decode("utf-8", "surrogatepass"), width) for z in table.column("z")]
                links, root = links_in(sets, table.column("weight").to_numpy(), np.zeros(len(keys), np.int32), True, similarity)
                yield from _linked(keys, links, root)

        yield from in_batches(found(), LINKS)

    links = small.repartition("task").sortWithinPartitions("task").mapInArrow(work, "key binary, links long, root binary")
    return links.unionByName(_large_links(rows.filter(F.col("n") > GROUP_BLOCK), width, similarity)) if large else links


def join(
    docs: DataFrame, similarity: float = SIMILARITY, width: int = WORDS, recall: float = RECALL
) -> DataFrame:
    """doc_id, class_id (smallest id of the class), n_links, and tie and rep (the class's first row) per document."""
    asked = _asked(docs)
    signed = written(_sets(asked, width), "sets-of-documents")
    sets = signed.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.count(F.lit(1)).alias("weight"), F.min(F.struct("doc_id", "tie")).alias("rep"), F.first("signature").alias("signature"),
        F.min("doc_id").alias("least"),
    )
    sets = written(_marked(sets), "sets")
    edges = _candidate_edges(_leaves(sets, similarity, recall), sets, similarity)
    groups = components(edges)
    links = written(_exact_links(asked, sets, groups, width, similarity), "links")
    classes = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    named = sets.select("key", "weight", "rep", "least").join(classes, "key", "left").join(counts, "key", "left")
    named = written(named.withColumn("label", F.coalesce("label", "key")), "set-classes")
    firsts = named.groupBy("label").agg(F.min("least").alias("class_id"), F.min("rep").alias("first"))
    of_set = written(
        named.join(firsts, "label").select("key", "class_id", "first", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")),
        "class-of-set",
    )
    rows = signed.select("doc_id", "tie", "key").join(of_set, "key", "left")
    own = F.struct("doc_id", "tie")
    return rows.select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("key").isNull(), own).otherwise(F.col("first")).alias("first"),
        "tie",
    )


def _marked(sets: DataFrame) -> DataFrame:
    """With ``mark``: a byte of every signature token, enough to count agreements."""
    kinds = StructType([*sets.schema.fields, StructField("mark", BinaryType())])

    def work(batches):
        for batch in batches:
            marks = (_signatures(batch) & np.uint32(0xFF)).astype(np.uint8)
            column = pa.array([m.tobytes() for m in marks], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "mark"])

    return sets.mapInArrow(work, kinds)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the first document of each class (smallest id, a null id before all others), all columns unchanged.

    A null or wordless text is a class of its own and stays; rows equal in id and text are one
    document; an empty table stays empty.
    """
    firsts = join(docs).select("first").distinct().select(F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie"))
    rows, place = packed(docs, doc_id=F.col("doc_id").cast("long"), tie=F.lit(0).cast("long")), docs.columns.index("text")

    def ties(batches):
        for batch in batches:
            tie = pa.array([tie_of(t or "") for t in cells_of(batch.column("row"), place)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), tie], ["row", "doc_id", "tie"])

    rows = rows.mapInArrow(ties, rows.schema)
    kept = rows.join(firsts, rows["doc_id"].eqNullSafe(firsts["first_id"]) & (rows["tie"] == firsts["first_tie"]), "left_semi")
    return unpacked(kept.dropDuplicates(["doc_id", "tie"]), docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT r, doc_id, list_distinct(list_transform(range(greatest(len(w) - 4, least(len(w), 1))),
    lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS g FROM d),
sets AS MATERIALIZED (SELECT r, len(g)::BIGINT AS size, unnest(g) AS gram FROM grams),
shared AS (
  SELECT a.r AS a, b.r AS b, any_value(a.size) AS x, any_value(b.size) AS y, count(*) AS n
  FROM sets a JOIN sets b ON a.gram = b.gram AND a.r <> b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE n >= 0.8 * (x + y - n)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
labels AS (SELECT a, min(doc_id) AS least FROM reach JOIN grams ON reach.b = grams.r GROUP BY a),
counts AS (SELECT a, count(*)::BIGINT AS n FROM links GROUP BY a)
SELECT doc_id, least(doc_id, labels.least) AS class_id, coalesce(n, 0) AS n_links
FROM grams LEFT JOIN labels ON labels.a = grams.r LEFT JOIN counts ON counts.a = grams.r
"""
