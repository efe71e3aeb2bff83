import numpy as np
import pytest
from conftest_llm import collected, texts_of, words

from tallyframe.llm import chosen_path as C
from tallyframe.llm.tables import read


def grams(text):
    parts = [w for w in (text or "").lower().translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
    width = min(5, len(parts))
    return {tuple(parts[i : i + width]) for i in range(len(parts) - width + 1)} if parts else set()


def brute(rows):
    """(doc_id, class, links) by all pairs."""
    sets, n = [grams(t) for _, t in rows], len(rows)
    root = list(range(n))
    links = [0] * n

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(((doc, least.get(top(i)), links[i]) for i, (doc, _) in enumerate(rows)), key=str)


def result(docs):
    return sorted(collected(C.join(docs).select("doc_id", "class_id", "n_links")), key=str)


def near_copies(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    base = words(200, 77).split(" ")
    rows = []
    for i in range(n):
        mine = list(base)
        for at in rng.integers(0, 200, rng.integers(0, 6)):
            mine[at] = f"w{i}x{at}"
        rows.append((i, " ".join(mine)))
    rows += [(10_000 + i, words(40, 500 + i) + " " + words(60, 3)) for i in range(n)]  # a shared passage
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_all_pairs(spark, edge_docs, no_docs):
    for docs in (edge_docs, read(spark, "/root/testdata/sf0.001", "documents"), near_copies(spark, 60)):
        assert result(docs) == brute(texts_of(docs))
    assert result(no_docs) == []


def test_splitting_and_blocks(spark, monkeypatch):
    for name, value in (("SMALL", 8), ("BUCKET_BLOCK", 16), ("GROUP_BLOCK", 16), ("DELTA_BLOCK", 20), ("PIVOTS", 4)):
        monkeypatch.setattr(C, name, value)
    docs = near_copies(spark, 90, seed=5)
    docs = docs.unionByName(docs.filter("doc_id % 7 = 0")).repartition(4)  # repeated rows
    assert result(docs) == brute(texts_of(docs))


def test_blocks_follow_bytes(spark, monkeypatch):
    for name, value in (("GROUP_BLOCK", 10), ("DELTA_BYTES", 9000)):
        monkeypatch.setattr(C, name, value)
    docs = near_copies(spark, 70, seed=9)
    assert result(docs) == brute(texts_of(docs))


@pytest.mark.parametrize("pivots", [0, 2, 40])
def test_pivots_lose_no_near_pair(spark, monkeypatch, pivots):
    """Balls, chains between balls and sets outside all balls: every near pair ends in one component."""
    monkeypatch.setattr(C, "PIVOTS", pivots)
    monkeypatch.setattr(C, "BUCKET_BLOCK", 25)
    rng = np.random.default_rng(6)
    marks = [rng.integers(0, 256, C.SIGNATURE).astype(np.uint8)]
    for i in range(239):
        of = marks[rng.integers(len(marks))].copy() if i % 8 else rng.integers(0, 256, C.SIGNATURE).astype(np.uint8)
        of[rng.choice(C.SIGNATURE, rng.integers(0, 60), replace=False)] = rng.integers(0, 256)
        marks.append(of)
    keys = [i.to_bytes(16) for i in range(len(marks))]
    sets = spark.createDataFrame([(bytearray(k), bytearray(m.tobytes())) for k, m in zip(keys, marks)], "key binary, mark binary")
    leaves = spark.createDataFrame([(5, bytearray(k), len(keys)) for k in keys], "path long, key binary, n long")
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in C._candidate_edges(leaves, sets, 0.8).collect():
        root[top(bytes(a))] = top(bytes(b))
    near = (np.array(marks)[:, None] == np.array(marks)[None]).sum(axis=2) >= C._least(0.8)
    assert near.sum() > 2 * len(marks)
    assert all(top(keys[i]) == top(keys[j]) for i, j in zip(*np.nonzero(near)))


def test_links_from_differences():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 400, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(150, len(base)), replace=False), rng.integers(400, 440, 30).astype(np.uint64)])) for _ in range(20)]
    weights, side = rng.integers(1, 5, 20), rng.integers(0, 2, 20)
    apart = [np.setxor1d(x, base) for x in sets]
    lost = np.array([len(np.setdiff1d(base, x)) for x in sets])
    size = np.array([len(x) for x in sets])
    for whole in (True, False):
        plain = C.links_in(sets, weights, side, whole, 0.6)
        coded = C.links_of(C.overlaps(apart), len(base), lost, size, weights, side, whole, 0.6)
        assert (plain[0] == coded[0]).all() and (plain[1] == coded[1]).all() and plain[0].any()


def test_groups_of_signatures_against_all_pairs():
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 3, (60, C.SIGNATURE)).astype(np.uint8)
    marks[20:40] = marks[5]
    marks[30, :40] += 1
    label = C.linked_groups(marks, 80)
    near = (marks[:, None] == marks[None]).sum(axis=2) >= 80
    reach = near.copy()
    for _ in range(7):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert ((label[:, None] == label[None]) == reach).all()


@pytest.mark.parametrize("m", [3, 12])
def test_overlaps(m):
    rng = np.random.default_rng(m)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(m)]
    got = C.overlaps(sets)
    assert all(got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(m) for j in range(m) if i != j)


def test_runs_rise_with_recall():
    assert C.runs_for(0.9, 0.8) < C.runs_for(0.9999, 0.8) < C.runs_for(0.999999, 0.8)


def test_stage_keeps_one_of_each_class(spark, edge_docs, no_docs):
    kept = C.near_duplicate_stage(spark, edge_docs, "")
    assert kept.columns == edge_docs.columns and kept.dtypes == edge_docs.dtypes
    rows = texts_of(edge_docs)
    wordless = [r for r in set(rows) if not grams(r[1])]
    classes = {c for (d, c, _) in brute([r for r in rows if grams(r[1])])}
    assert kept.count() == len(wordless) + len(classes)
    assert C.near_duplicate_stage(spark, no_docs, "").count() == 0
