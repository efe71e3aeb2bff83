import hashlib
import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import collected, texts_of, words

from tallyframe.llm import suffixes as S
from tallyframe.llm.tables import read


def with_passage(rows, size=400, least=256, words=50):
    """(id, text) of documents with a passage that another document has, from every string of every document."""
    owners = defaultdict(set)
    strings = []
    for doc, text in rows:
        raw = (text or "").encode()
        begins = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
        inside = {k for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw) for k in range(*m.span())}
        for s in range(len(raw) - least + 1):
            k = bisect_right(begins, s) + words - (s in inside)
            end = max(begins[k] + 1, s + least) if k < len(begins) else None
            end = end if end and end <= min(s + size, len(raw)) else None
            if end:
                owners[raw[s:end]].add((doc, text))
                strings.append(((doc, text), raw[s:end]))
    return {owner for owner, string in strings if len(owners[string]) > 1}


def brute(rows, size=400, keep="none", passages=None):
    """All strings of ``size`` bytes in one dictionary."""
    texts = [(doc, text or "") for doc, text in rows]
    if passages is None:
        passages = with_passage(texts, size)
    places = defaultdict(list)
    rows = [(doc, (text or "").encode()) for doc, text in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, S.tie_of(rows[i][1])))
    for i in order:
        raw = rows[i][1]
        for s in range(len(raw) - size + 1):
            places[raw[s : s + size]].append((i, s))
    gone = [np.zeros(len(raw), bool) for _, raw in rows]
    for found in places.values():
        if len(found) > 1:
            for i, s in found[keep == "first" :]:
                gone[i][s : s + size] = True
    out = []
    for (doc, raw), g, owner in zip(rows, gone, texts):
        edge = np.diff(np.concatenate([[0], g.astype(int), [0]]))
        kept = bytes(np.frombuffer(raw, np.uint8)[~g])
        out.append((doc, len(raw), int(g.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest(), owner in passages))
    return sorted(out, key=str)


def passages(spark):
    shared = [words(90, 900 + i) for i in range(4)]
    rows = []
    for i in range(40):
        parts = [words(30 + i, i), shared[i % 4], words(20, 70 + i), shared[(i * 3) % 4][: 150 + 17 * i], words(10, 200 + i)]
        rows.append((i, " ".join(parts)))
    rows += [(50, "ab" * 700), (51, "x" * 2000), (52, shared[0] + shared[0]), (53, rows[3][1]), (54, rows[3][1].replace("a", "b", 1))]
    rows += [(55, None), (56, ""), (57, "y" * 400), (58, "z" * 401), (59, "é" * 399)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def result(docs, **more):
    return sorted(collected(S.deduplicated(docs, **more)), key=str)


def test_against_all_strings(spark, edge_docs, no_docs):
    for docs in (passages(spark), edge_docs, read(spark, "/root/testdata/sf0.001", "documents")):
        assert result(docs, keep="none") == brute(texts_of(docs))
    assert result(no_docs) == []


def test_keeping_the_first(spark):
    docs = passages(spark)
    assert result(docs, keep="first") == brute(texts_of(docs), keep="first")
    short = {"least": 45, "words": 6}
    found = with_passage(texts_of(docs), 60, **short)
    assert result(docs, keep="first", size=60, gram=25, **short) == brute(texts_of(docs), 60, keep="first", passages=found)
    assert result(docs, keep="none", size=60, gram=45, **short) == brute(texts_of(docs), 60, passages=found)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_anchors(spark, monkeypatch, keep):
    monkeypatch.setattr(S, "HOT", 2)
    docs = passages(spark)
    assert result(docs, keep=keep) == brute(texts_of(docs), keep=keep)


def test_passages_shorter_than_what_is_removed(spark):
    """Of more than 50 words in 256 to 400 bytes: told, but nothing goes."""
    passage = " ".join(words(1, 40 + i)[:5] for i in range(60))
    assert 256 < len(passage) < 400
    texts = [words(40, 1) + "\n" + passage + "\n" + words(30, 2), words(20, 3) + " " + passage, passage, "a " + passage[:-40] + "! " + words(9, 4)]
    texts += [words(200, 5), words(20, 6) + passage[:240], passage[:150] + words(50, 7) + passage[:150], words(45, 8) * 2]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string").repartition(3)
    got = {r[0]: (r[2], r[5]) for r in result(docs, keep="none") if r[0] != 4}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 3: (0, True), 5: (0, False), 6: (0, False), 7: (0, False)}
    assert result(docs, keep="none") == brute(texts_of(docs))


def longest(data, a, b, size, limits):
    room = min(size, limits[a] - a, limits[b] - b)
    return next((k for k in range(room) if data[a + k] != data[b + k]), room)


@pytest.mark.parametrize(("letters", "size", "n"), [(2, 12, 300), (2, 40, 200), (1, 30, 120), (3, 5, 150), (30, 400, 500)])
def test_factors_against_all_pairs(letters, size, n):
    rng = np.random.default_rng(letters * size)
    data = np.concatenate([rng.integers(0, letters, n), rng.integers(0, letters, n // 3)]).astype(np.uint8) + np.uint8(97)
    data = np.concatenate([data, data[n // 4 : n // 2], data[: n // 3]])
    starts = np.sort(rng.choice(len(data), len(data) * 2 // 3, replace=False))
    labels = rng.integers(0, 4, len(starts))
    limits, order = np.full(len(starts), len(data)), S.Order(data, size)
    earlier, source, chain = S.factors(order, starts, limits)
    asked = labels != 2
    other = S.elsewhere(order, starts, limits, labels, chain, asked)
    end = dict.fromkeys(starts.tolist(), len(data))
    pairs = {(a, b): longest(data, a, b, size, end) for a in end for b in end if a < b}
    both = lambda a, b: pairs[min(a, b), max(a, b)]
    at = starts.tolist()
    assert earlier.tolist() == [max([both(a, b) for b in at[:i]], default=0) for i, a in enumerate(at)]
    assert all(both(at[i], at[j]) == earlier[i] and j < i if j >= 0 else earlier[i] == 0 for i, j in enumerate(source.tolist()))
    # what a factor of full length was found at occurs later, and nothing else does
    later = {i for i in range(len(at)) if any(both(at[i], b) == size for b in at[i + 1 :])}
    assert set(source[earlier >= size].tolist()) == later
    want = [max([both(a, b) for b, m in zip(at, labels) if m != labels[i]], default=0) for i, a in enumerate(at)]
    assert other.tolist() == [w if ask else 0 for w, ask in zip(want, asked)]
    inner = [i for i in chain.tolist() if at[i] + size <= len(data)]
    assert [bytes(data[at[i] : at[i] + size]) for i in inner] == sorted(bytes(data[at[i] : at[i] + size]) for i in inner)


def test_nearest_smaller_places():
    rng = np.random.default_rng(1)
    for values in (rng.permutation(200), np.arange(50), -np.arange(50), rng.integers(0, 5, 100), np.zeros(1, int)):
        before, after = S.nearest_smaller(values)
        for i, v in enumerate(values):
            assert before[i] == max([k for k in range(i) if values[k] < v], default=-1)
            assert after[i] == min([k for k in range(i + 1, len(values)) if values[k] < v], default=-1)


def test_every_string_has_one_anchor():
    data = words(400, 8).encode()
    _, _, _, first, own, limit = S.anchors([data], 150, 100, 40)
    assert first[0] == 0 and (first[1:] == first[:-1] + own[:-1]).all() and first[-1] + own[-1] == len(data) - 99
    assert (limit == np.minimum(first + own + 149, len(data))).all()


def test_texts_worked_on_together_have_their_own_anchors():
    texts = [words(n, n).encode() for n in (60, 1, 0, 17, 200, 18, 3, 90)] + [b"x" * 100, b"x" * 99, b"x" * 180, b""]
    together = list(zip(*[c.tolist() for c in S.anchors(texts, 150, 100, 40)]))
    alone = [(i, *row[1:]) for i, t in enumerate(texts) for row in zip(*[c.tolist() for c in S.anchors([t], 150, 100, 40)])]
    assert together == alone and len({r[0] for r in alone}) > 5
    assert all(len(c) == 0 for c in S.anchors([b"a"] * 150, 150, 100, 40)) and all(len(c) == 0 for c in S.anchors([], 150, 100, 40))


def test_an_anchor_with_as_many_contexts_as_one_task_takes():
    """Orders and factors of ``HOT`` contexts stay within a task's memory."""
    import tracemalloc

    rng = np.random.default_rng(4)
    middle = rng.integers(97, 120, S.GRAM)
    side = S.LEAST - S.GRAM
    parts = [np.concatenate([rng.integers(97, 120, side), middle, rng.integers(97, 120, S.SIZE - S.GRAM)]) for _ in range(S.HOT)]
    data = np.concatenate(parts).astype(np.uint8)
    starts = np.concatenate([np.arange(i * len(parts[0]), i * len(parts[0]) + side) for i in range(S.HOT)])
    tracemalloc.start()
    order, labels = S.Order(data, S.SIZE), np.repeat(np.arange(S.HOT), side)
    earlier, _, chain = S.factors(order, starts, starts + S.SIZE)
    S.elsewhere(order, starts, starts + S.SIZE, labels, chain, labels % 2 == 0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert earlier.max() < S.SIZE and (earlier[side:] >= S.GRAM).sum() >= S.HOT - 1
    assert most < 300_000_000
