"""Removal of byte strings that occur more than once, by longest-previous-factor arrays per anchor.

A byte goes if it lies in a string of ``SIZE`` bytes that starts somewhere else as well.
Suffixes of the whole table cannot be sorted in one place, so they are dealt out first:
every string of ``LEAST`` bytes belongs to an anchor, the smallest hash of the ``GRAM``-byte
runs inside it, rightmost of equals.  Equal strings have equal anchors at equal offsets, so
only suffixes of one anchor have to be compared.  An anchor owns the suffixes that start in
one short range; their first ``SIZE`` bytes (fewer at a text's end) are its context.

* Anchors that occur once are done.  Contexts that occur several times whole are repeated
  whole, whatever their number; they are only counted, by 128 bits of hashes.
* Where an anchor has different contexts, one copy of each goes to the anchor's task.  There
  the owned suffixes are put in order by ranks of 8, 24 and 72 bytes, each rank from three
  ranks of a third of the length (``Order``); equal ranks are equal bytes.  For every suffix the
  previous and the next one in suffix order with a smaller position give the longest previous
  factor and where it was found (``factors``): one of ``SIZE`` bytes says that the string
  occurs earlier, and that the one it was found at occurs later.  The nearest suffixes of
  another document give the longest match with another document (``elsewhere``).
* An anchor with more than ``HOT`` different contexts does not go to one task: its strings
  are counted one by one by a 128-bit hash, which is summed before the exchange.

``keep="first"`` leaves the first occurrence (by document id, then position) of every
string, ``keep="none"`` removes all.  ``repeats_passage`` tells a document in which more than
``PASSAGE`` words (runs without ASCII white space, cut ones at the ends counted) that take
``LEAST`` to ``SIZE`` bytes occur in another document too, whatever is removed.  Texts travel compressed.

Defined cases: a null text is empty; texts shorter than ``SIZE`` lose nothing; equal rows
are occurrences of each other but no other documents, and with ``keep="first"`` rows of equal
id and text count as one place and stay; null ids come first; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.tables import in_batches, read, rows_of, whole_text, written
from tallyframe.llm.winnowing import mixed, powers, smallest

SIZE, LEAST, GRAM, PASSAGE = 400, 256, 64, 50
HOT, TASK_BYTES, TOGETHER = 4_000, 100_000, 30_000
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
STEP = np.uint64(0xA0761D6478BD642F)
LOW = np.uint64(0xFFFFFFFF)
#: Owned starts from ``start`` to ``end`` whose bytes up to ``limit`` occur again; kind REMOVED, REPEATED (also in
#: another document), KEPT (the same, but nothing goes) or PASSAGE_FOUND (nothing goes, but another document has a passage of it).
REMOVED, REPEATED, PASSAGE_FOUND, KEPT = 0, 1, 2, 3
SPAN = "doc_id long, tie int, start int, end int, limit int, kind int"
SPANS = pa.schema([("doc_id", pa.int64()), *[(n, pa.int32()) for n in ("tie", "start", "end", "limit", "kind")]])


class Hashes:
    """Hashes of any run of bytes of one text, from running sums."""

    def __init__(self, data: np.ndarray):
        self.up = powers("up", len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers("down", len(data)))])

    def all_of(self, long: int) -> np.ndarray:
        """Of every run of ``long`` bytes."""
        n = len(self.sums) - long
        return mixed((self.sums[long:] - self.sums[:n]) * self.up[:n] + np.array([long], np.uint64) * STEP)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64) * STEP)


def anchors(texts: list[bytes], size: int, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(number of the text, anchor hash, context hash, first owned start, number of owned starts, end of the context) of all anchors.

    Short texts are worked on together, as one array.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < least:
        return (np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    ends = np.cumsum([len(t) for t in texts])
    hashes = Hashes(data)
    grams = hashes.all_of(gram)
    key = (grams & ~LOW) | (LOW - np.arange(len(grams), dtype=np.uint64))
    place = smallest(key, least - gram + 1) & LOW  # of the string that starts here, counted from the end
    if len(texts) > 1:
        strings = np.repeat(ends, [len(t) for t in texts])[: len(place)] >= np.arange(least, len(data) + 1)  # within one text
        at = np.flatnonzero(strings)
        place = place[at]
    else:
        at = np.arange(len(place))
    if not len(at):
        return anchors([], size, least, gram)
    turns = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])  # texts share no place
    first, own, place = at[turns], np.diff(np.append(turns, len(place))), (LOW - place[turns]).astype(np.int64)
    text = np.searchsorted(ends, first, "right")
    limit = np.minimum(first + own - 1 + size, ends[text])
    context = mixed(hashes.of(first, limit) * STEP + (place - first).astype(np.uint64) * mixed(own.astype(np.uint64)))
    begin = np.concatenate([[0], ends[:-1]])[text]
    return text, grams[place], context, first - begin, own, limit - begin


def tie_of(raw: bytes) -> int:
    return xxhash.xxh32_intdigest(raw) - (1 << 31)


def raw_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _anchor_rows(docs: DataFrame, size: int, least: int, gram: int) -> DataFrame:
    names = ["a", "c", "doc_id", "tie", "lo", "own", "lim"]

    def made(docs: list, raws: list[bytes]) -> pa.RecordBatch:
        text, a, c, lo, own, lim = anchors(raws, size, least, gram)
        at = pa.array(text, pa.int32())
        known, ties = pa.array(docs, pa.int64()).take(at), pa.array([tie_of(r) for r in raws], pa.int32()).take(at)
        columns = [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), known, ties]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int32()) for x in (lo, own, lim)]], names)

    def work(batches):
        docs, raws, heavy = [], [], 0
        for doc, text in rows_of(batches, "doc_id", "text"):
            docs.append(doc)
            raws.append(raw_of(text))
            heavy += len(raws[-1])
            if heavy >= TOGETHER:
                yield made(docs, raws)
                docs, raws, heavy = [], [], 0
        if docs:
            yield made(docs, raws)

    return docs.mapInArrow(work, "a long, c long, doc_id long, tie int, lo int, own int, lim int")


def _squeezed(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int32()), ("z", pa.binary())])

    def work(batches):
        small = zstandard.ZstdCompressor(level=1)
        raws = ((doc, raw_of(text)) for doc, text in rows_of(batches, "doc_id", "text"))
        yield from in_batches(((doc, tie_of(raw), small.compress(raw)) for doc, raw in raws), schema)

    return docs.mapInArrow(work, "doc_id long, tie int, z binary")


def _with_text(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """doc_id, z and ``list`` of ``lists`` (of_id, of_tie, list)."""
    texts = _squeezed(docs)
    same = texts["doc_id"].eqNullSafe(lists["of_id"]) & (texts["tie"] == lists["of_tie"])
    return texts.join(lists, same, how).select("doc_id", "tie", "z", "list")


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1], new[1:] = True, ordered[1:] != ordered[:-1]
    ranks = np.empty(len(keys), np.uint32)
    ranks[order] = np.cumsum(new, dtype=np.uint32)
    return ranks


class Order:
    """Ranks of the runs of 8, 24 and 72 bytes at every place of ``data``, for order by ``size`` bytes and common prefixes.

    A rank comes from three ranks of a third of the length; from two of half the length where
    three do not fit into 64 bits.  The longest runs have a sixth of ``size`` (or a quarter), so
    that two numbers hold the ranks of all ``size`` bytes.
    """

    def __init__(self, data: np.ndarray, size: int):
        self.size, n, room = size, len(data), 3 * size + 16
        self.data = np.concatenate([data, np.zeros(room + 16, np.uint8)])
        eight = np.empty(n, np.uint64)
        for k in range(8):
            count = len(eight[k::8])
            eight[k::8] = self.data[k : k + 8 * count].view(">u8")
        self.arity = 3 if n < 1 << 21 else 2
        long = min(8, size)
        self.levels = [(long, self._ranked(eight >> np.uint64(64 - 8 * long), room))]
        while 2 * self.arity * long < size:
            ranks = self.levels[-1][1]
            both = self._joined([ranks[k * long : n + k * long] for k in range(self.arity)])
            long *= self.arity
            self.levels.append((long, self._ranked(both, room)))

    def _joined(self, ranks: list[np.ndarray]) -> np.ndarray:
        bits, out = np.uint64(64 // self.arity), ranks[0].astype(np.uint64)
        for more in ranks[1:]:
            out = (out << bits) | more
        return out

    @staticmethod
    def _ranked(keys: np.ndarray, room: int) -> np.ndarray:
        return np.concatenate([dense(keys), np.zeros(room, np.uint32)])

    def order(self, starts: np.ndarray) -> np.ndarray:
        """The places in ``starts`` (ascending) by their first ``size`` bytes, equal ones by position."""
        long, ranks = self.levels[-1]
        at = [min(k * long, self.size - long) for k in range(2 * self.arity)]
        keys = [self._joined([ranks[starts + k] for k in half]) for half in (at[: self.arity], at[self.arity :])]
        return np.lexsort(keys[::-1])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at places ``a`` and ``b``, up to ``size``."""
        long = np.zeros(len(a), np.int64)
        for k, (size, ranks) in enumerate(reversed(self.levels)):
            for _ in range(self.arity - 1 if k else self.size // size):
                long += np.where(ranks[a + long] == ranks[b + long], size, 0)
        same = np.ones(len(a), bool)
        for _ in range(self.levels[0][0]):
            same &= self.data[a + long] == self.data[b + long]
            long += same
        return np.minimum(long, self.size)


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the nearest places before and after it with a smaller value, -1 where there is none; by minima of runs."""

    def before(v: np.ndarray) -> np.ndarray:
        lows = [v]  # lows[k][i]: the smallest of the 2**k values up to i
        while 2 << len(lows) <= 2 * len(v):
            last, step = lows[-1], 1 << (len(lows) - 1)
            lows.append(np.concatenate([last[:step], np.minimum(last[step:], last[:-step])]))
        at = np.arange(len(v)) - 1
        for k in range(len(lows) - 1, -1, -1):
            far = at - (1 << k) >= -1
            far &= lows[k][np.maximum(at, 0)] >= v
            at = np.where(far, at - (1 << k), at)
        return at

    values = values.astype(np.int32)
    mirrored = before(values[::-1])[::-1]
    return before(values), np.where(mirrored < 0, -1, len(values) - 1 - mirrored)


def factors(order: Order, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest previous factor of every suffix, up to ``size``, the number of the suffix it was found at (-1: none), and the suffix order.

    ``starts`` ascend, a suffix ends at its limit.  Of all suffixes with a smaller position, the
    nearest ones in suffix order to both sides have the longest common prefix with it.  Suffixes
    equal in ``size`` bytes stand by position, so each of them but the last is where the next one's factor is found.
    """
    chain = order.order(starts)
    long, source = np.zeros(len(chain), np.int64), np.full(len(chain), -1)
    for near in nearest_smaller(chain):
        more = _common(order, starts, limits, chain, chain[near])
        more[near < 0] = -1
        better = more > long
        long[better], source[better] = more[better], chain[near[better]]
    found, at = np.empty(len(chain), np.int64), np.empty(len(chain), np.int64)
    found[chain], at[chain] = long, source
    return found, at, chain


def elsewhere(order: Order, starts: np.ndarray, limits: np.ndarray, labels: np.ndarray, chain: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Longest match of the ``asked`` suffixes with one of another label, up to ``size``; 0 for the others."""
    label = labels[chain]
    turn = np.concatenate([[True], label[1:] != label[:-1]])
    run = np.maximum.accumulate(np.where(turn, np.arange(len(chain)), 0))
    end = np.append(np.flatnonzero(turn)[1:], len(chain))[np.cumsum(turn) - 1]
    out, some = np.zeros(len(chain), np.int64), np.flatnonzero(asked[chain])
    for near in (run[some] - 1, end[some]):
        there = (near >= 0) & (near < len(chain))
        a, b = chain[some[there]], chain[near[there]]
        out[a] = np.maximum(out[a], _common(order, starts, limits, a, b))
    return out


def _common(order: Order, starts: np.ndarray, limits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of the suffixes with numbers ``a`` and ``b``."""
    room = np.minimum(limits[a] - starts[a], limits[b] - starts[b])
    return np.minimum(order.common(starts[a], starts[b]), room)


class Words:
    """Where the words of a text begin."""

    def __init__(self, data: np.ndarray):
        self.inside = ~SPACE[data]
        begins = np.flatnonzero(self.inside & ~np.concatenate([[False], self.inside[:-1]]))
        self.begins = np.append(begins, np.int64(1) << 40)  # none

    def passage_ends(self, starts: np.ndarray, words: int, least: int) -> np.ndarray:
        """For each start the end of the shortest string from it with ``least`` bytes in which more than ``words`` words have begun."""
        last = np.searchsorted(self.begins, starts, "right") + words - self.inside[starts]
        return np.maximum(self.begins[np.minimum(last, len(self.begins) - 1)] + 1, starts + least)


def _context_spans(contexts: DataFrame, size: int, least: int, words: int, keep: str) -> DataFrame:
    """Spans from contexts a, doc_id, tie, lo, own, n, many (documents), context."""

    def settle(rows: list[tuple]) -> Iterator[tuple]:
        rows = sorted({(r[0], r[1] is not None, *r[1:]) for r in rows}, key=lambda r: (r[1], r[2] or 0, r[3], r[4]))
        # a context that the text's end cuts is told from what follows by a byte that no text has, and a number
        parts = [r[8] if len(r[8]) == r[5] - 1 + size else r[8] + b"\xff" + i.to_bytes(7) for i, r in enumerate(rows)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        bases = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
        owned = [r[5] for r in rows]
        starts = np.concatenate([np.arange(b, b + n) for b, n in zip(bases, owned)])
        limits = np.repeat([b + len(r[8]) for b, r in zip(bases, rows)], owned)
        places = {d: i for i, d in enumerate(dict.fromkeys(r[1:4] for r in rows))}
        labels = np.repeat([-1 - i if r[7] else places[r[1:4]] for i, r in enumerate(rows)], owned)
        order = Order(data, size)
        long, source, chain = factors(order, starts, limits)
        gone = long >= size
        if keep == "none":
            gone[source[gone]] = True
        alone = np.repeat([not r[7] for r in rows], owned)
        match = elsewhere(order, starts, limits, labels, chain, alone)
        shared = Words(data).passage_ends(starts, words, least) - starts <= match
        at = 0
        for (_, _, doc, tie, lo, own, n, many, _), base in zip(rows, bases):
            mine, passage = np.concatenate([[False], gone[at : at + own], [False]]), shared[at : at + own].any()
            at += own
            if passage and not many:
                yield doc, tie, lo, lo, lo, PASSAGE_FOUND
            if n > 1 and keep == "none":
                continue  # whole context repeated, and counted as such
            turns = np.flatnonzero(mine[1:] != mine[:-1])
            for s, e in zip(turns[::2].tolist(), turns[1::2].tolist()):
                yield doc, tie, lo + s, lo + e - 1, lo + e - 1 + size, REMOVED

    def work(batches):
        def spans():
            held, task, heavy = [], None, 0
            for row in rows_of(batches, "a", "doc_id", "tie", "lo", "own", "n", "many", "context"):
                if row[0] != task and heavy > TASK_BYTES:
                    yield from settle(held)
                    held, heavy = [], 0
                task = row[0]
                held.append(row)
                heavy += len(row[7])
            if held:
                yield from settle(held)

        yield from in_batches(spans(), SPANS, size=20_000)

    return contexts.repartition("a").sortWithinPartitions("a").mapInArrow(work, SPAN)


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One copy of every wanted context (a, doc_id, tie, lo, own, lim, n, many) with its bytes."""
    cell = F.struct("a", "lo", "own", "lim", "n", "many")
    lists = wanted.groupBy(F.col("doc_id").alias("of_id"), F.col("tie").alias("of_tie")).agg(F.collect_list(cell).alias("list"))
    schema = pa.schema(
        [("a", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int32()), ("lo", pa.int32()), ("own", pa.int32()), ("n", pa.int64()),
         ("many", pa.bool_()), ("context", pa.binary())]
    )

    def work(batches):
        def rows():
            expand = zstandard.ZstdDecompressor()
            for doc, tie, z, cells in rows_of(batches, "doc_id", "tie", "z", "list"):
                raw = expand.decompress(z)
                for x in cells:
                    yield x["a"], doc, tie, x["lo"], x["own"], x["n"], x["many"], raw[x["lo"] : x["lim"]]

        yield from in_batches(rows(), schema)

    return _with_text(docs, lists, "inner").mapInArrow(
        work, "a long, doc_id long, tie int, lo int, own int, n long, many boolean, context binary"
    )


def _hot_spans(docs: DataFrame, wanted: DataFrame, size: int, least: int, words: int, keep: str) -> DataFrame:
    """Spans of contexts of hot anchors: every owned string, and every passage, is counted by its hash."""
    schema = pa.schema(
        [("h", pa.binary()), ("passage", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int32()), ("start", pa.int32()), ("n", pa.int64()),
         ("many", pa.bool_())]
    )

    def work(batches):
        def rows():
            for doc, tie, lo, own, n, many, context in rows_of(batches, "doc_id", "tie", "lo", "own", "n", "many", "context"):
                ends = Words(np.frombuffer(context, np.uint8)).passage_ends(np.arange(own), words, least)
                for k, end in enumerate(ends.tolist()):
                    if k + size <= len(context):
                        yield xxhash.xxh3_128_digest(context[k : k + size]), False, doc, tie, lo + k, n, many
                    if end <= min(k + size, len(context)):
                        yield xxhash.xxh3_128_digest(context[k:end]), True, doc, tie, lo + k, n, many

        yield from in_batches(rows(), schema, size=20_000)

    found = _contexts(docs, wanted).mapInArrow(work, "h binary, passage boolean, doc_id long, tie int, start int, n long, many boolean")
    found = written(found.distinct(), "hot-strings")
    own = F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie", "start")
    document = F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie")
    counted = found.groupBy(F.col("h").alias("of"), F.col("passage").alias("of_passage")).agg(
        F.count(F.lit(1)).alias("places"), F.min(own).alias("first"), (F.max("many") | (F.min(document) != F.max(document))).alias("others")
    ).filter("places > 1")
    both = found.join(counted, (F.col("h") == F.col("of")) & (F.col("passage") == F.col("of_passage")))
    lost = F.col("n") == 1 if keep == "none" else ~own.eqNullSafe(F.col("first"))
    gone = both.filter(~F.col("passage") & lost).select(
        "doc_id", "tie", "start", F.col("start").alias("end"), (F.col("start") + size).alias("limit"), F.lit(REMOVED).alias("kind")
    )
    shared = both.filter(F.col("passage") & F.col("others")).select("doc_id", "tie").distinct()
    zero = [F.lit(0).alias(n) for n in ("start", "end", "limit")]
    return gone.unionByName(shared.select("doc_id", "tie", *zero, F.lit(PASSAGE_FOUND).alias("kind")))


def spans(docs: DataFrame, size: int = SIZE, least: int = LEAST, gram: int = GRAM, words: int = PASSAGE, keep: str = "first") -> DataFrame:
    """What repeats, as rows of ``SPAN``."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    if not gram <= least <= size:
        raise ValueError("gram <= least <= size")
    rows = written(_anchor_rows(docs, size, least, gram), "anchors")
    often = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))
    often = written(often.filter("n > 1").select("a", (F.col("least") != F.col("most")).alias("mixed")), "anchors-often")
    rows = written(rows.join(often, "a"), "anchors-repeated")
    document = [F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie"]
    place = F.struct(*document, "lo", "lim")
    kinds = rows.groupBy("a", "c", "mixed").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.first("own").alias("own"),
        (F.min(F.struct(*document)) != F.max(F.struct(*document))).alias("many"),
    )
    kinds = written(kinds, "contexts")
    copies = rows.join(kinds.filter("n > 1").select("a", "c", "first", "many"), ["a", "c"])
    # the first copy stays with keep="first", but it may be a passage of other documents
    kind = F.when(F.col("many"), REPEATED).otherwise(REMOVED)
    out = copies.select("doc_id", "tie", F.col("lo").alias("start"), (F.col("lo") + F.col("own") - 1).alias("end"), F.col("lim").alias("limit"), kind.alias("kind"))
    if keep == "first":
        stays = place.eqNullSafe(F.col("first"))
        out = copies.select(
            "doc_id", "tie", F.col("lo").alias("start"), (F.col("lo") + F.col("own") - 1).alias("end"), F.col("lim").alias("limit"),
            F.when(stays, KEPT).otherwise(kind).alias("kind"), "many",
        ).filter(f"kind <> {KEPT} or many").drop("many")
    unlike = kinds.filter("mixed").select("a", "first.doc_id", "first.tie", "first.lo", "own", "first.lim", "n", "many")
    sizes = written(unlike.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > HOT).select("a"), "hot-anchors")
    out = out.unionByName(_context_spans(_contexts(docs, unlike.join(sizes, "a", "left_anti")), size, least, words, keep))
    if not sizes.isEmpty():
        out = out.unionByName(_hot_spans(docs, unlike.join(sizes, "a"), size, least, words, keep))
    return out


def cut(raw: bytes, ranges: list[tuple[int, int]], size: int) -> tuple[bytes, int, int]:
    """What stays of a text, how many bytes went, and in how many runs."""
    kept, at, gone, runs = [], 0, 0, 0
    low = high = None
    for start, end in [*sorted(ranges), (None, None)]:
        if low is not None and (start is None or start > high):
            kept.append(raw[at:low])
            at, gone, runs = high, gone + high - low, runs + 1
            low = None
        if start is not None:
            low, high = (start, end + size) if low is None else (low, max(high, end + size))
    kept.append(raw[at:])
    return b"".join(kept), gone, runs


def _has_passage(raw: bytes, ranges: list[tuple], size: int, least: int, words: int) -> bool:
    """Whether one of the repeated ranges has a passage of another document."""
    if any(kind == PASSAGE_FOUND for *_, kind in ranges):
        return True
    ranges = [r for r in ranges if r[3] in (REPEATED, KEPT)]
    found = Words(np.frombuffer(raw, np.uint8)) if ranges else None
    for start, end, limit, _ in ranges:
        starts = np.arange(start, end + 1)
        if (found.passage_ends(starts, words, least) <= np.minimum(limit, starts + size)).any():
            return True
    return False


def deduplicated(
    docs: DataFrame, size: int = SIZE, least: int = LEAST, gram: int = GRAM, words: int = PASSAGE, keep: str = "first", texts: bool = False
) -> DataFrame:
    """Per document its bytes, removed bytes and runs, the hash of what stays (with ``texts`` also the bytes that stay), and repeats_passage."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    cell = F.struct("start", "end", "limit", "kind")
    found = spans(docs, size, least, gram, words, keep)
    lists = found.groupBy(F.col("doc_id").alias("of_id"), F.col("tie").alias("of_tie")).agg(F.collect_list(cell).alias("list"))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
         ("kept_sha256", pa.string()), ("kept", pa.binary()), ("repeats_passage", pa.bool_())]
    )

    def work(batches):
        def rows():
            expand = zstandard.ZstdDecompressor()
            for doc, z, found in rows_of(batches, "doc_id", "z", "list"):
                raw, ranges = expand.decompress(z), [(r["start"], r["end"], r["limit"], r["kind"]) for r in found or ()]
                lost = [(a, min(b, limit - size)) for a, b, limit, kind in ranges if kind in (REMOVED, REPEATED) and a + size <= limit]
                kept, gone, runs = cut(raw, lost, size)
                shared = _has_passage(raw, ranges, size, least, words)
                yield doc, len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept if texts else None, shared

        yield from in_batches(rows(), schema)

    out = _with_text(docs, lists, "left").mapInArrow(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, repeats_passage boolean"
    )
    return out if texts else out.drop("kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"), keep="none")
