import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import collected, edge_texts, texts_of, words

from tallyframe.llm import resampling as R
from tallyframe.llm.tables import read
from tallyframe.llm.words import words_of

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, n):
    w = tokens(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode("utf-8")) % buckets


def brute(docs, target, n=1, buckets=10_000, seed=2024, least=20, percent=10):
    s = Counter(bucket(f, buckets) for _, t in docs for f in features(t, n))
    t = Counter(bucket(f, buckets) for text in target for f in features(text, n))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        mine = [gain[bucket(f, buckets)] for f in features(text, n)]
        weight = sum(mine) // len(mine) if mine else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(mine), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(tokens(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    take = percent * len(able) // 100
    drawn = [(*r[:4], i + 1 if i < take else None) for i, r in enumerate(able)]
    return drawn + [(*r[:4], None) for r in rows if not r[4]]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def test_query_against_brute_force(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        target = [r[0] for r in read(spark, folder, "benchmark").select("text").collect()]
        got = collected(R.op13_importance_resample(spark, folder))
        assert ordered(got) == ordered(brute(texts_of(read(spark, folder, "documents")), target))
    assert sum(r[4] is not None for r in got) > 50


@pytest.mark.parametrize("n", [1, 2, 4])
def test_runs_of_words_with_odd_rows(spark, edge_docs, no_docs, n):
    docs, target = texts_of(edge_docs), [None, "", words(300, 1), "a\nb\n\nc d", "É\né"]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, words int")
    got = collected(R.resampled(edge_docs, frame, n=n, buckets=97, least_words=3, percent=50))
    assert ordered(got) == ordered(brute(docs, target, n, 97, least=3, percent=50))
    assert collected(R.resampled(no_docs, frame, n=n)) == []
    nothing = collected(R.resampled(edge_docs, frame.limit(0), n=n, percent=0))
    assert ordered(nothing) == ordered(brute(docs, [], n, percent=0))


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_lines_and_crossing_runs_make_all_features(n):
    for text in [t for t in edge_texts() if t and len(t) < 5000] + ["a\nb\nc\n\nd e f g h i j\nk", "one two three four five six seven\neight nine", "\n\n a \n"]:
        lines = [words_of(x) for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
        got = Counter(f for w in lines for f in R.runs(w, n)) + Counter(R.crossing(lines, n))
        assert got == Counter(f.encode("utf-8", "surrogatepass") for f in features(text, n))


def test_small_caches_and_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(R, "KEPT_LINES", 2)
    monkeypatch.setattr(R, "KEPT_RUNS", 3)
    docs = [(i % 40, words(25, i % 7, "abcd") + "\nthe same line\n" * 3) for i in range(400)]
    target = [words(40, 3, "abcd")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = collected(R.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent=37))
    assert ordered(got) == ordered(brute(docs, target, percent=37))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 149))
