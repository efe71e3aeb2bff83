"""Reversible line deduplication: sharded cuckoo filters before exact reference counts.

A line's key is the line without white space at its ends and with A-Z in lower case, as
a 128-bit hash; shorter keys than ``LEAST_CHARS`` code points do not count.  The exact
state is a table of references (key, document) and its counts (documents per key, and the
largest id that holds it).  Per shard of keys a cuckoo filter holds the keys that reached
``LEAST_DOCS`` documents.  Lines are asked of the filters first; only hits go to the exact
counts, so a false hit changes nothing.  Inserting documents adds references and enters
the keys that reach the limit; deleting documents takes their references back and removes
the keys that fall below it.  Either step shuffles and writes only the keys of its documents
and the filters of shards in which a key crossed the limit; what it leaves alone is read from
where it is.  A deletion reads the references in the range of its ids, and those of keys that
lose their largest id.  ``compacted`` writes a state anew after many steps.

A key in a third of all documents is summed before its exchange, and its references are
spread over salted copies of its shard's filter.

Defined cases: a null or empty text is one empty line; every row counts as a document of
its own; of rows without an id every repeated line goes while a row with an id holds it; an
empty table gives no rows; other columns are ignored, in the pipeline they are kept and
``n_chars`` follows the text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.tables import cells_of, in_batches, packed, read, rows_of, shuffle_partitions, unpacked, whole_text, with_cells, written

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Shards at least; more where the session has more shuffle partitions, so that a filter stays small.
SHARDS = 64
GROUP_ROWS = 200_000
SPACE = " \t\n\x0b\x0c\r"
REFERENCES = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64())])


def line_key(line: str, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The key of a line, None for one that is too short to count."""
    core = line.strip(SPACE)
    if len(core) < least_chars:
        return None
    return xxhash.xxh3_128_digest(core.encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only


def shard_of(key: bytes, shards: int) -> int:
    """From bytes that neither the filter's buckets (1 to 7) nor its fingerprints (8, 9) use, so each shard has keys of all buckets."""
    return int.from_bytes(key[12:16]) % shards


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four, each in one of two buckets; keys are 16 bytes."""

    SLOTS, KICKS = 4, 400

    def __init__(self, room: int, table: np.ndarray | None = None):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, room) / self.SLOTS / 0.84))))
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys given as rows of two 64-bit numbers."""
        mark = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        mask = np.uint64(len(self.table) - 1)
        first = (keys[:, 0] >> np.uint64(8)) & mask
        return mark, first, first ^ self._step(mark)

    def _step(self, mark: np.ndarray) -> np.ndarray:
        spread = mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(20)) & np.uint64(len(self.table) - 1)

    @staticmethod
    def numbers(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)

    def insert(self, keys: list[bytes]) -> bool:
        """Enter keys; False when there is no room, and the filter must be built anew with more."""
        table, rng = self.table, np.random.default_rng(1)
        for mark, a, b in zip(*map(np.ndarray.tolist, self._where(self.numbers(keys)))) if keys else ():
            at = a if (table[a] == 0).any() else b
            for _ in range(self.KICKS):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = mark
                    break
                slot = int(rng.integers(self.SLOTS))
                mark, table[at, slot] = int(table[at, slot]), mark
                at ^= int(self._step(np.array([mark], np.uint16))[0])
            else:
                return False
        return True

    def delete(self, keys: list[bytes]) -> None:
        """Remove keys that were entered before."""
        for mark, a, b in zip(*map(np.ndarray.tolist, self._where(self.numbers(keys)))) if keys else ():
            for at in (a, b):
                found = np.flatnonzero(self.table[at] == mark)
                if len(found):
                    self.table[at, found[0]] = 0
                    break

    def holds(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        mark, a, b = self._where(self.numbers(keys))
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)


@dataclass
class Lines:
    """The state: references (shard, key, doc_id), counts (shard, key, n_docs, keeper), filters (shard, data)."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    least_docs: int = LEAST_DOCS


def references(docs: DataFrame, shards: int, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per document and different key."""

    def work(batches):
        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                for key in {line_key(line, least_chars) for line in text.split("\n")} - {None}:
                    yield shard_of(key, shards), key, doc

        yield from in_batches(rows(), REFERENCES, size=20_000)

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return asked.mapInArrow(work, "shard int, key binary, doc_id long")


def counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def _filter_of(keys: list[bytes]) -> CuckooFilter:
    room = len(keys)
    while not (made := CuckooFilter(room)).insert(keys):
        room = 2 * max(8, room)
    return made


def _built(counts: DataFrame, least_docs: int) -> DataFrame:
    def work(table: pa.Table) -> pa.Table:
        made = _filter_of(table.column("key").to_pylist())
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int32()), "data": pa.array([made.to_bytes()], pa.binary())})

    return counts.filter(F.col("n_docs") >= least_docs).select("shard", "key").groupBy("shard").applyInArrow(work, "shard int, data binary")


def build(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shards: int | None = None) -> Lines:
    """The state of a first lot of documents."""
    shards = shards or max(SHARDS, shuffle_partitions(docs.sparkSession))
    refs = written(references(docs, shards, least_chars), "line-references")
    counts = written(counted(refs), "line-counts")
    return Lines(refs, counts, written(_built(counts, least_docs), "line-filters"), shards, least_docs)


def _stepped(state: Lines, references: DataFrame, touched: DataFrame) -> Lines:
    """The state after a step that leaves ``touched`` (shard, key, was, n_docs, keeper) of the keys it met; was: n_docs before."""
    touched = written(touched, "line-touched")
    kept = state.counts.join(touched.select("shard", "key"), ["shard", "key"], "left_anti")
    counts = kept.unionByName(touched.filter("n_docs > 0").select(state.counts.columns))
    enters, leaves = F.col("n_docs") >= state.least_docs, F.col("was") >= state.least_docs
    crossed = touched.select("shard", "key", enters.alias("now")).filter(enters != leaves)

    def work(keys: pa.Table, held: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        rows = list(zip(keys.column("key").to_pylist(), keys.column("now").to_pylist()))
        data = held.column("data").to_pylist()
        made = CuckooFilter.from_bytes(data[0]) if data else CuckooFilter(len(rows))
        made.delete([k for k, now in rows if not now])
        room = made.insert([k for k, now in rows if now])
        return pa.table({"shard": keys.column("shard")[:1].cast(pa.int32()), "data": pa.array([made.to_bytes() if room else None], pa.binary())})

    held = state.filters.join(crossed.select("shard").distinct(), "shard", "left_semi")
    changed = crossed.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(work, "shard int, data binary")
    changed = written(changed, "line-filters")
    full = changed.filter("data is null").select("shard")
    filters = state.filters.join(changed.select("shard"), "shard", "left_anti").unionByName(changed.filter("data is not null"))
    if not full.isEmpty():  # no room left in these: built anew from all their keys
        filters = filters.unionByName(written(_built(counts.join(full, "shard", "left_semi"), state.least_docs), "line-filters"))
    return Lines(references, counts, filters, state.shards, state.least_docs)


def insert(state: Lines, docs: DataFrame, least_chars: int = LEAST_CHARS) -> Lines:
    """The state with further documents; old references are not read."""
    more = written(references(docs, state.shards, least_chars), "line-references")
    new = counted(more).withColumnsRenamed({"n_docs": "more", "keeper": "new_keeper"})
    was = F.coalesce("n_docs", F.lit(0))
    touched = new.join(state.counts, ["shard", "key"], "left").select(
        "shard", "key", was.alias("was"), (was + F.col("more")).alias("n_docs"), F.greatest("keeper", "new_keeper").alias("keeper")
    )
    return _stepped(state, state.references.unionByName(more), touched)


def delete(state: Lines, doc_ids: DataFrame) -> Lines:
    """The state as if the documents with these ids had never been inserted."""
    gone = written(doc_ids.select(F.col("doc_id").cast("long").alias("gone")).distinct(), "line-gone")
    ends = gone.agg(F.min("gone").alias("low"), F.max("gone").alias("high"), F.max(F.col("gone").isNull()).alias("none")).first()
    near = F.col("doc_id").between(ends["low"], ends["high"]) if ends["low"] is not None else F.lit(False)
    near = near | F.col("doc_id").isNull() if ends["none"] else near
    same = F.col("doc_id").eqNullSafe(F.col("gone"))
    left = state.references.join(gone, same, "left_anti")
    lost = state.references.filter(near).join(gone, same, "left_semi").groupBy("shard", "key").agg(F.count(F.lit(1)).alias("less"))
    touched = state.counts.join(lost, ["shard", "key"]).select(
        "shard", "key", F.col("n_docs").alias("was"), (F.col("n_docs") - F.col("less")).alias("n_docs"), "keeper"
    )
    touched = written(touched, "line-touched")
    # keys that lose their largest id look for the next one among their references
    orphans = touched.filter("n_docs > 0").join(gone, F.col("keeper").eqNullSafe(F.col("gone")), "left_semi").select("shard", "key")
    next_ = left.join(orphans, ["shard", "key"], "left_semi").groupBy("shard", "key").agg(F.max("doc_id").alias("next"), F.lit(True).alias("found"))
    touched = touched.join(next_, ["shard", "key"], "left").select(
        "shard", "key", "was", "n_docs", F.when(F.col("found"), F.col("next")).otherwise(F.col("keeper")).alias("keeper")
    )
    return _stepped(state, left, touched)


def compacted(state: Lines) -> Lines:
    """The same state in tables of its own, without the steps that led to it."""
    refs, counts = written(state.references, "line-references"), written(state.counts, "line-counts")
    return Lines(refs, counts, written(state.filters, "line-filters"), state.shards, state.least_docs)


def dropped(state: Lines) -> DataFrame:
    """doc_id and the keys whose lines it loses."""
    largest = state.counts.groupBy("shard").agg(F.sum("n_docs").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    salts = -(-largest // GROUP_ROWS) or 1
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    asked = state.references.withColumn("salt", salt).groupBy("shard", "salt")
    copies = state.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).groupBy("shard", "salt")

    def hits(refs: pa.Table, held: pa.Table) -> pa.Table:
        part = refs.select(["shard", "key", "doc_id"]).cast(REFERENCES)
        if not held.num_rows or not refs.num_rows:
            return part.slice(0, 0)
        found = CuckooFilter.from_bytes(held.column("data")[0].as_py()).holds(part.column("key").to_pylist())
        return part.filter(pa.array(found, pa.bool_()))

    found = asked.cogroup(copies).applyInArrow(hits, "shard int, key binary, doc_id long")
    exact = state.counts.filter(F.col("n_docs") >= state.least_docs).select("shard", "key", "keeper")
    lose = found.join(exact, ["shard", "key"]).filter(
        F.col("keeper").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    )
    return lose.groupBy(F.col("doc_id").alias("loser")).agg(F.collect_set("key").alias("keys"))


def cleaned(text: str, keys: list[bytes] | None, least_chars: int = LEAST_CHARS) -> tuple[str, int, int]:
    """The text without the lines of ``keys``, its number of lines before, and how many went."""
    lines = text.split("\n")
    if not keys:
        return text, len(lines), 0
    gone = set(keys)
    kept = [line for line in lines if line_key(line, least_chars) not in gone]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of what stays, per document."""
    lose = dropped(build(docs))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def work(batches):
        def rows():
            for doc, text, keys in rows_of(batches, "doc_id", "text", "keys"):
                kept, lines, gone = cleaned(text, keys)
                yield doc, lines, gone, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()

        yield from in_batches(rows(), schema)

    joined = asked.join(lose, F.col("doc_id").eqNullSafe(F.col("loser")), "left").select("doc_id", "text", "keys")
    return joined.mapInArrow(work, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, without their repeated lines.

    A null text stays null, a text that loses all lines is empty; other columns are unchanged but
    for ``n_chars``, which follows the text where the table has it; an empty table stays empty.
    """
    lose = dropped(build(docs))
    rows, place = packed(docs, doc_id=F.col("doc_id").cast("long")), docs.columns.index("text")
    joined = rows.join(lose, F.col("doc_id").eqNullSafe(F.col("loser")), "left").select("row", "keys")

    def work(batches):
        for batch in batches:
            texts = cells_of(batch.column("row"), place)
            kept = [cleaned(t, k)[0] if k and t is not None else t for t, k in zip(texts, batch.column("keys").to_pylist())]
            yield pa.RecordBatch.from_arrays([with_cells(batch.column("row"), place, pa.array(kept, pa.string()))], ["row"])

    made = joined.mapInArrow(work, joined.select("row").schema)
    length = {"n_chars": F.length("row.text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return unpacked(made, docs.columns, **length)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(read(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT rid, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
c AS (
  SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT rid, doc_id, key FROM k WHERE length(key) >= 40)
  GROUP BY key HAVING count(*) >= 5),
m AS (
  SELECT k.*, c.keeper IS NOT NULL AND (doc_id IS NULL OR doc_id < keeper) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
