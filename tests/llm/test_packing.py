import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from conftest_llm import collected, texts_of
from tokenizers import Tokenizer

from tallyframe.llm import packing as P
from tallyframe.llm.tables import read


def check_pieces(rows, texts, tokens=1024, segments=P.SEGMENTS):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = defaultdict(list)
    for doc, text in texts:
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        expected[doc].append(np.array(ids, "<u4"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_sequence[r[5]].append(r)
    assert set(by_doc) == set(expected)
    for doc, pieces in by_doc.items():
        assert sum(p[2] for p in pieces) == sum(map(len, expected[doc]))
        if len(expected[doc]) == 1:
            ids, at = expected[doc][0], 0
            for p in sorted(pieces, key=lambda p: p[1]):
                assert p[1] == at and p[4] == len(ids)
                assert p[3] == zlib.crc32(ids[at : at + p[2]].tobytes())
                at += p[2]
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert 0 < at <= tokens and len(pieces) <= segments
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return padding


def test_sequences_of_all_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = collected(P.pack(docs.repartition(3)))
    assert check_pieces(rows, texts_of(docs)) == 0


def test_edge_cases(edge_docs, no_docs):
    docs = edge_docs.persist()
    check_pieces(collected(P.pack(docs)), texts_of(docs))
    assert collected(P.pack(no_docs)) == []


def test_limits_hold_together():
    rng = np.random.default_rng(1)
    examples = []
    for i in range(400):
        n = int(rng.integers(1, 200))
        examples.append((i, np.arange(n, dtype=np.uint32), (np.arange(n) >= n // 2).astype(np.uint8)))
    rows = list(P.pack_examples(iter(examples), tokens=256, segments=4, loss=100))
    masks = {i: m for i, _, m in examples}
    by = defaultdict(list)
    for doc, start, length, _, _, sequence, offset in rows:
        by[sequence].append((offset, length, int(masks[doc][start : start + length].sum())))
    assert all(sum(p[1] for p in v) <= 256 and len(v) <= 4 and sum(p[2] for p in v) <= 100 for v in by.values())
    assert sum(r[2] for r in rows) == sum(len(m) for m in masks.values())


def test_special_strings_and_long_runs():
    tok = P.ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a<|endoftext|>b", "x" * 5000, " " * 4000 + "q", "naïve 🙂\n\n  two", "'s 'LL don't", "   x"):
        assert tok.ids(text).tolist() == tok.exact.encode(text, add_special_tokens=False).ids


def test_sequences_closed_by_segments_need_no_padding():
    import numpy as np

    from tallyframe.llm import packing

    examples = [(i, np.arange(5, dtype=np.uint32), np.ones(5, np.uint8)) for i in range(3 * packing.POOL)]
    rows = list(packing.pack_examples(iter(examples), 1024, 128, 1024))
    assert sum(r[2] for r in rows) == 5 * len(examples)
    pieces, lengths = {}, {}
    for row in rows:
        pieces[row[5]] = pieces.get(row[5], 0) + 1
        lengths[row[5]] = lengths.get(row[5], 0) + row[2]
    assert max(pieces.values()) <= 128
    assert all(n & (n - 1) == 0 for n in lengths.values())


def naive(pieces, limits):
    """The dot-product heuristic one candidate at a time, without cuts: sequences of example numbers."""
    share = [[n / m for n, m in zip(p, limits)] for p in pieces]
    sums = [sum(s[d] for s in share) for d in range(3)]
    weight = [s / sum(sums) for s in sums]
    left, out = set(range(len(pieces))), []
    while left:
        room, mine = list(limits), []
        while fits := [i for i in sorted(left) if all(n <= r for n, r in zip(pieces[i], room))]:
            best = max(fits, key=lambda i: (sum(share[i][d] * weight[d] * room[d] / limits[d] for d in range(3)), -i))
            left.remove(best)
            mine.append(best)
            room = [r - n for r, n in zip(room, pieces[best])]
        out.append(mine)
    return out


def chats(n, seed, tokens, loss):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        size = int(rng.integers(1, tokens // 2))
        bears = int(size * rng.choice([0.05, 0.5, 0.95]))
        out.append((i, np.arange(size, dtype=np.uint32), (np.arange(size) >= size - min(bears, loss)).astype(np.uint8)))
    return out


def test_choices_of_the_heuristic():
    limits = (256, 6, 96)
    for seed in range(4):
        examples = chats(120, seed, 256, 96)
        wanted = naive([(len(ids), 1, int(mask.sum())) for _, ids, mask in examples], limits)
        found = defaultdict(list)
        for doc, _, length, _, total, sequence, _ in P.pack_examples(iter(examples), *limits, cuts=False):
            assert length == total
            found[sequence].append(doc)
        assert list(found.values()) == wanted
        loads = [sum(len(e[1]) for e in examples) / 256, len(examples) / 6, sum(int(e[2].sum()) for e in examples) / 96]
        assert len(wanted) <= 1.25 * max(loads) + 1


def test_each_limit_binds():
    examples = chats(900, 9, 256, 96)
    closed = set()
    by = defaultdict(list)
    masks = {i: m for i, _, m in examples}
    for doc, start, length, _, _, sequence, _ in P.pack_examples(iter(examples), 256, 6, 96, cuts=False):
        by[sequence].append((length, 1, int(masks[doc][start : start + length].sum())))
    for pieces in by.values():
        load = [sum(p[d] for p in pieces) for d in range(3)]
        assert load[0] <= 256 and load[1] <= 6 and load[2] <= 96
        closed |= {d for d, most in enumerate((240, 6, 90)) if load[d] >= most}
    assert closed == {0, 1, 2}


def check_chats(rows, turns_of, tokens, segments, loss, turns):
    """Every id once, in order; whole examples unless a limit forbids it; the limits; the loss of every piece."""
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda t: exact.encode(t, add_special_tokens=False).ids
    want = {}
    for conv, of in turns_of.items():
        for part in range(0, len(of), turns):
            ids, mask = [], []
            for role, text in of[part : part + turns]:
                head, body = encode(f"{role or ''}\n"), [*encode(text or ""), 0]
                ids += head + body
                mask += [0] * len(head) + [int(role == "assistant")] * len(body)
            want[conv, part // turns] = (np.array(ids, "<u4"), mask)
    found, sequences = defaultdict(list), defaultdict(list)
    for conv, part, n_loss, start, length, crc, total, sequence, offset in rows:
        found[conv, part].append((start, length, crc, total, n_loss))
        sequences[sequence].append((offset, length, n_loss))
    assert set(found) == set(want)
    for key, pieces in found.items():
        ids, mask = want[key]
        at = 0
        for start, length, crc, total, n_loss in sorted(pieces):
            assert start == at and total == len(ids) and n_loss == sum(mask[at : at + length])
            assert crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids) and (len(pieces) == 1 or len(ids) > tokens or sum(mask) > loss)
    for pieces in sequences.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= tokens and len(pieces) <= segments and sum(p[2] for p in pieces) <= loss


def test_conversations(spark):
    rows = read(spark, "/root/testdata/sf0.01", "conversations")
    turns_of = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns_of[r["conv_id"]].append((r["role"], r["text"]))
    unique = {c: t for c, t in turns_of.items()}
    got = collected(P.pack_conversations(rows, tokens=512, segments=6, loss=256))
    check_chats(got, unique, 512, 6, 256, P.TURNS)
    assert collected(P.pack_conversations(rows.limit(0))) == []


def test_odd_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} " + "word " * (i % 40)) for i in range(500)]  # one long conversation
    rows += [(None, None, None, None), (None, 0, "user", ""), (None, 1, "assistant", "x" * 3000), (2, 5, "assistant", "ok"), (3, 0, None, "é🙂")]
    rows += [(4, 0, "assistant", "many words " * 900)]
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, part int, place string").repartition(4)
    turns_of = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        turns_of[conv].append((role, text))
    got = collected(P.pack_conversations(frame, tokens=300, segments=3, loss=120, turns=7))
    check_chats(got, turns_of, 300, 3, 120, 7)
    assert len({r[1] for r in got if r[0] == 1}) == 72
