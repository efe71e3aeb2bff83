import hashlib

import pytest
from conftest_llm import collected, texts_of, words

from tallyframe.llm import winnowing as W
from tallyframe.llm.tables import read


def slow_winnow(text, gram, window):
    """Choose by looking at every window."""
    hashes = [int(h) for h in W.gram_hashes(text, gram)] if text else []
    chosen = set()
    for start in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = range(start, min(len(hashes), start + window))
        chosen.add(min(part, key=lambda i: (hashes[i] >> 32, -i)))
    return sorted(chosen)


def test_hash_depends_on_the_gram_alone():
    a, b = W.gram_hashes("xxabcdefg", 4), W.gram_hashes("abcdefgyy", 4)
    assert a[2:6].tolist() == b[:4].tolist() and len(set(a.tolist())) == len(a)


def test_winnow_against_all_windows():
    for text in ("", "a", "abcabcabcabc", "a" * 300, "the quick brown fox " * 9, "".join(chr(97 + i * i % 23) for i in range(500))):
        for gram, window in ((3, 4), (5, 1), (8, 16)):
            assert W.winnow(text, gram, window)[1].tolist() == slow_winnow(text, gram, window), (text[:9], gram, window)


def test_shared_run_shares_a_fingerprint():
    run = "".join(chr(97 + (i * 7919 + i * i) % 26) for i in range(95))
    a, b = W.Marked(1, "01234" * 30 + run), W.Marked(2, run + "987" * 70)
    assert a.sets[0] & b.sets[0]
    for at, (below, gram, window) in enumerate(W.SCALES):
        piece = run[: gram + window - 1]
        a, b = W.Marked(1, ("01234" * 30 + piece)[-min(below - 1, 200) :]), W.Marked(2, (piece + "987" * 70)[: min(below - 1, 200)])
        assert a.sets[at] & b.sets[at] and a.like(b) > 0


def prints_of(text):
    """Fingerprint and hashes by scale, every window looked at."""
    parts, sets = [], []
    for below, gram, window in W.SCALES:
        if text and len(text) < below:
            hashes, at = [int(h) >> 16 for h in W.gram_hashes(text, gram)], slow_winnow(text, gram, window)
            parts.append(",".join(f"{hashes[i]:012x}@{i}" for i in at))
            sets.append({hashes[i] for i in at})
    return ";".join(parts), sets


def like(a, b):
    if not a or not b:
        return float(a == b)
    a, b = (x[min(len(a), len(b)) - 1] for x in (a, b))
    return len(a & b) / len(a | b)


def order_of(spark, rows):
    ties = spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) as h").collect()
    ties = {r["t"]: r["h"] for r in ties}
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1] or ""]))


def brute(spark, rows):
    """All columns; the next document in order of id and text hash."""
    rows, out = order_of(spark, rows), []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        (mine, sets), (other, edited_sets) = prints_of(text), prints_of(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((doc, len(text), sha, mine, other, like(sets, edited_sets), like(sets, prints_of(after)[1])))
    return sorted(out, key=str)


def test_next_document_across_ranges(spark):
    rows = [(i * 7 % 101, f"document {i} " + chr(97 + i % 26) * (i * 13 % 190)) for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = W.fingerprints(docs)
    assert got.columns[:7] == "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    assert sorted(collected(got), key=str) == brute(spark, rows)


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    assert sorted(collected(W.op1_winnowing(spark, folder)), key=str) == brute(spark, texts_of(read(spark, folder, "documents")))


def test_short_texts_are_like_their_edited_selves(spark):
    rows = [(i, words(60, i)[: 4 + i]) for i in range(150)]
    got = collected(W.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert all(r[5] > 0.2 for r in got) and sum(r[5] for r in got) / len(got) > 0.5
    assert sum(r[6] for r in got) / len(got) < 0.1


@pytest.mark.parametrize("hot", [7, None])
def test_ids_and_rows_that_fill_many_ranges(spark, monkeypatch, hot):
    monkeypatch.setattr(W, "COPIES", 9)
    rows = [(i, words(20 + i % 5, i)) for i in range(60)] + [(hot, words(15, 300 + i)) for i in range(150)] + [(hot, "the same row again and again")] * 170
    rows += [(8, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    _, found = W._cuts(docs.selectExpr("coalesce(doc_id, -9223372036854775808) as key", "xxhash64(text) as tie"), 32)
    assert len(found) == 1
    assert sorted(collected(W.fingerprints(docs)), key=str) == brute(spark, rows)


def test_edge_cases(spark, edge_docs, no_docs):
    rows = collected(W.fingerprints(edge_docs))
    assert sorted((r[0] is not None, r[0]) for r in rows if r[0]) == sorted((True, d) for d, _ in texts_of(edge_docs) if d)
    assert len(rows) == edge_docs.count()
    assert sorted(rows, key=str) == brute(spark, texts_of(edge_docs))
    assert {r[3] for r in rows if r[1] == 0} == {""}
    assert collected(W.fingerprints(no_docs)) == []
    alone = collected(W.fingerprints(edge_docs.filter("doc_id = 42").limit(1)))
    assert len(alone) == 1 and alone[0][6] == 1.0
