"""Packing of token sequences under several limits at once (vector bin packing).

A sequence has room for ``tokens`` ids, ``segments`` pieces and ``loss`` loss-bearing
ids.  Whole multiples of ``tokens`` are cut off long documents and fill sequences of
their own; what remains is placed by the dot-product heuristic: into the open sequence
goes the piece that fits and whose needs, as shares of the limits, have the largest
product with the room that is left.  If none fits, the piece that is largest is cut to
the gap.  Every task packs its own rows, so nothing is shuffled, and no document is
larger than its task's memory.  The last open sequence of a task, and any that another
limit closes before it is full, is cut into powers of two, which need no padding.

Conversations (``pack_conversations``) are examples in which only the turns of some roles bear
loss, so all three limits bind.  An example that fits the limits is never cut; into the open
sequence goes the fitting one with the largest product, and where none fits the sequence is
closed and padded.  A conversation is numbered by turn and makes an example for every
``TURNS`` turns, so one that holds a third of all rows is many examples in many tasks.

Defined cases: a null text is an empty text and has the closing id alone; null and
repeated document ids are packed like others; an empty table gives no rows; other
columns are ignored.  Turns without a conversation are one conversation; turns of equal
number follow one another by a hash of their row; a null role is empty and bears no loss.
The pipeline's stage takes the same cases, and a document that the mix repeats as often as it comes.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm.tables import in_batches, read, rows_of, whole_text
from tallyframe.operators.ordered import in_pieces, numbered

TOKENS, SEGMENTS, POOL = 1024, 128, 2048
#: Limits for conversations, and the turns of an example.
CHAT_TOKENS, CHAT_SEGMENTS, CHAT_LOSS, TURNS, LEARNED = 2048, 16, 1024, 64, ("assistant",)
#: Runs this long go to the other library, whose work does not grow with their square.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteTokenizer:
    """The ids that ``tokenizers`` gives for a byte-level vocabulary file, computed faster.

    The file's own vocabulary drives the other library; the first texts of every
    process are held against ``tokenizers``, and texts with very long runs always
    come from it.
    """

    def __init__(self, path: str, checks: int = 4):
        self.exact, self.checks = Tokenizer.from_file(path), checks
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes the file writes as themselves
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}
        special = self.exact.get_added_tokens_decoder()
        self.special = [str(t) for t in special.values()]
        ranks = {k: v for k, v in ranks.items() if v not in special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if LONG_RUN.search(text) or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        found = np.array(self.fast.encode_ordinary(text), "<u4")
        if self.checks and len(text) < 100_000:
            self.checks -= 1
            if self.exact.encode(text, add_special_tokens=False).ids != found.tolist():
                raise ValueError("the two libraries disagree on this vocabulary")
        return found


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


class Piece:
    """A run of a document's ids that has not been placed yet."""

    __slots__ = ("doc", "start", "ids", "loss", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, loss: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.loss, self.total = doc, start, ids, loss, total

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[:at], self.loss[:at], self.total),
            Piece(self.doc, self.start + at, self.ids[at:], self.loss[at:], self.total),
        )


def fill(pieces: list[Piece], limits: np.ndarray, last: bool, cuts: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of ``pieces`` by the dot-product heuristic, and the pieces of one that is not full.

    With ``last`` nothing is left over: every sequence is closed.  Without ``cuts`` pieces,
    which then have to fit the limits, stay whole.
    """
    if not pieces:
        return [], []
    size = len(pieces)
    need = np.zeros((size, 3))
    held = list(pieces)
    need[:] = [(len(p.ids), 1, int(p.loss.sum())) for p in pieces]
    live, sequences = np.ones(size, bool), []
    share = need / limits
    weight = share.sum(axis=0) / share.sum()
    while live.any():
        room, mine = limits.astype(float).copy(), []
        while True:
            at = np.flatnonzero(live)
            if not len(at) or room[0] < 1 or room[1] < 1:
                break
            fits = at[(need[at] <= room).all(axis=1)]
            if len(fits):
                i = int(fits[np.argmax(share[fits] @ (weight * room / limits))])
                placed = held[i]
                live[i] = False
            elif not cuts:
                break
            else:
                i = int(at[np.argmax(need[at, 0])])
                allowed = np.searchsorted(np.cumsum(held[i].loss), room[2], side="right")
                gap = int(min(room[0], allowed))
                if gap < 1:
                    break
                placed, rest = held[i].cut(gap)
                held[i], need[i] = rest, (len(rest.ids), 1, int(rest.loss.sum()))
                share[i] = need[i] / limits
            mine.append(placed)
            room -= (len(placed.ids), 1, int(placed.loss.sum()))
        if not mine:
            raise ValueError("a limit leaves no room for a single id")
        if not live.any() and room[0] >= 1 and room[1] >= 1 and not last:
            return sequences, mine
        sequences.append(mine)
    return sequences, []


def in_powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """A sequence that is not full as sequences whose lengths are powers of two."""
    rest = list(pieces)
    left = sum(len(p.ids) for p in rest)
    while left:
        room, mine = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            piece = rest.pop(0)
            if len(piece.ids) > room:
                piece, after = piece.cut(room)
                rest.insert(0, after)
            mine.append(piece)
            room -= len(piece.ids)
        yield mine


def pack_examples(
    examples: Iterator[tuple], tokens: int, segments: int, loss: int, first_id: int = 0, cuts: bool = True
) -> Iterator[tuple]:
    """Rows (example, start, length, crc, total, sequence, offset) for (example, ids, loss mask).

    Without ``cuts`` only examples that exceed a limit are cut, at that limit.
    """
    limits, number, pool = np.array([tokens, segments, loss]), first_id, []

    def rows(sequence: list[Piece]) -> Iterator[tuple]:
        offset = 0
        for p in sequence:
            yield p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, number, offset
            offset += len(p.ids)

    def parts(sequences: list[list[Piece]]) -> Iterator[list[Piece]]:
        """Full sequences as they are; one closed by another limit than ``tokens`` would be padded."""
        for sequence in sequences:
            full = sum(len(p.ids) for p in sequence) == tokens
            yield from [sequence] if full or not cuts else in_powers(sequence)

    for doc, ids, mask in examples:
        whole, total = Piece(doc, 0, ids, mask, len(ids)), len(ids)
        while cuts and len(whole.ids) >= tokens and int(whole.loss[:tokens].sum()) <= loss:
            full, whole = whole.cut(tokens)
            yield from rows([full])
            number += 1
        while not cuts and (len(whole.ids) > tokens or int(whole.loss.sum()) > loss):
            part, whole = whole.cut(min(tokens, int(np.searchsorted(np.cumsum(whole.loss), loss, side="right"))))
            pool.append(part)
        if len(whole.ids) and total:
            pool.append(whole)
        if len(pool) >= POOL:
            done, pool = fill(pool, limits, False, cuts)
            for part in parts(done):
                yield from rows(part)
                number += 1
    done, _ = fill(pool, limits, True, cuts)
    for part in parts(done):
        yield from rows(part)
        number += 1


def pack(
    docs: DataFrame, vocabulary: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``tokens`` ids.

    Every id of a text bears loss, the closing id 0 does not.  ``vocabulary`` is the
    path of the vocabulary file on the executors; by default the installed one.
    ``sequence_id`` holds the task's number above 2**40, so ids are unique without
    any exchange between tasks.
    """

    def work(batches):
        tok = tokenizer(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))

        def examples():
            for doc, text in rows_of(batches, "doc_id", "text"):
                ids = np.append(tok.ids(text), np.uint32(0))
                mask = np.ones(len(ids), np.uint8)
                mask[-1] = 0
                yield doc, ids, mask

        first = TaskContext.get().partitionId() << 40
        yield from in_batches(pack_examples(examples(), tokens, segments, loss, first), SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(work, RESULT)


CHAT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_loss", pa.int64()), *[SCHEMA.field(n) for n in SCHEMA.names[1:]]])


def chat_examples(rows: Iterator[tuple], tok: ByteTokenizer, learned: tuple[str, ...]) -> Iterator[tuple]:
    """((conversation, part), ids, loss mask) of ordered rows (conversation, part, role, text).

    A turn is its role and a line break, its text, and the closing id 0; the text and the closing
    id of learned roles bear loss.
    """
    key, ids, masks = None, [], []
    for conversation, part, role, text in rows:
        if (conversation, part) != key and ids:
            yield key, np.concatenate(ids), np.concatenate(masks)
            ids, masks = [], []
        key = (conversation, part)
        head, body = tok.ids(f"{role or ''}\n"), np.append(tok.ids(text or ""), np.uint32(0))
        ids += [head, body]
        masks += [np.zeros(len(head), np.uint8), np.full(len(body), role in learned, np.uint8)]
    if ids:
        yield key, np.concatenate(ids), np.concatenate(masks)


def pack_conversations(
    conversations: DataFrame, vocabulary: str | None = None, tokens: int = CHAT_TOKENS, segments: int = CHAT_SEGMENTS, loss: int = CHAT_LOSS,
    learned: tuple[str, ...] = LEARNED, turns: int = TURNS,
) -> DataFrame:
    """Pieces of conversations (conv_id, turn, role, text) in sequences with up to ``tokens`` ids, ``loss`` of them loss-bearing, of ``segments`` examples."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = numbered(in_pieces(rows, ["conv_id"], ["turn"]), ["conv_id"], ["turn"], "place")
    rows = rows.withColumn("part", F.floor((F.col("place") - 1) / turns)).select("conv_id", "part", "place", "role", "text")

    def work(batches):
        tok = tokenizer(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        masks: dict[tuple, np.ndarray] = {}

        def examples():
            for key, ids, mask in chat_examples(rows_of(batches, "conv_id", "part", "role", "text"), tok, learned):
                masks[key] = np.concatenate([[0], np.cumsum(mask)])
                yield key, ids, mask

        def packed_rows():
            left: dict[tuple, int] = {}
            first = TaskContext.get().partitionId() << 40
            for key, start, length, *rest in pack_examples(examples(), tokens, segments, loss, first, cuts=False):
                left[key] = left.get(key, 0) + length
                sums = masks[key]
                yield *key, int(sums[start + length] - sums[start]), start, length, *rest
                if left[key] == len(sums) - 1:
                    del left[key], masks[key]

        yield from in_batches(packed_rows(), CHAT)

    kinds = "conv_id long, part long, n_loss long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").mapInArrow(work, kinds)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents; a document that the mix repeats has pieces for each round."""
    return pack(docs)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
