import math
import re
from collections import Counter

import duckdb
import pytest
from conftest_llm import collected, texts_of, words

from tallyframe.llm import ranking as R
from tallyframe.llm.tables import read

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, item_id long, score long, rank string", "item_id long, text string, doc_id long"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in PATTERN.findall(text or "")]


def brute(docs, items, k=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(s for _, _, s in counted)
    having = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, size in counted:
            m, score = 100 - 25 + 25 * size * n // total, 0
            for w, times in Counter(terms(text)).items():
                if w in c:
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * having[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if gone else doc, -s) for r, (s, gone, doc) in enumerate(sorted(scores)[:k])]
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] is None, r[2] or 0))


def by_sql(folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con.execute(R.OP11_SQL).fetchall()


def test_query_against_sql_and_brute_force(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = in_order(collected(R.op11_ranked_search(spark, folder)))
        assert got == in_order(by_sql(folder))
    items = [tuple(r) for r in read(spark, folder, "benchmark").select("item_id", "text").collect()]
    assert got == in_order(brute(texts_of(read(spark, folder, "documents")), items))


@pytest.mark.parametrize(("short", "block", "docs", "k"), [(1, 4, 37, 5), (10**9, 8, 64, 3), (6, 16, 1000, 20), (3, 2, 11, 1)])
def test_short_and_long_lists_shards_and_blocks(spark, monkeypatch, short, block, docs, k):
    for name, value in (("SHORT", short), ("BLOCK", block), ("SHARD_DOCS", docs), ("CHUNK", 2)):
        monkeypatch.setattr(R, name, value)
    texts = [(i, words(5 + i % 40, i % 90, "abc")) for i in range(400)]
    items = [(i, words(12, 5000 + i, "abc")) for i in range(15)]
    got = R.ranked(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k)
    assert in_order(collected(got)) == in_order(brute(texts, items, k))


def test_shard_search_equals_all_scores():
    import numpy as np

    rng = np.random.default_rng(3)
    total, vocabulary = 3000, 60
    chance = np.concatenate([rng.uniform(0.3, 0.9, 20), rng.uniform(0.001, 0.04, 40)])
    has = rng.random((total, vocabulary)) < chance
    sizes, terms_ = has.sum(axis=1), np.nonzero(has)[1]
    counts = rng.integers(1, 6, len(terms_))
    n = rng.integers(1, 500, total)
    weights = np.array([R.weight(total, int(x)) for x in has.sum(axis=0)])
    shard = R.Shard(list(range(total)), n, terms_, counts, sizes, weights, total, int(n.sum()))
    doc = np.repeat(np.arange(total), sizes)
    score = R.impacts(weights[terms_], counts, R.lengths(n, total, int(n.sum()))[doc])
    for _ in range(40):
        query = [(int(t), int(rng.integers(1, 4))) for t in rng.choice(vocabulary, 12, replace=False)]
        full = np.zeros(total, np.int64)
        for t, times in query:
            np.add.at(full, doc[terms_ == t], times * score[terms_ == t])
        order = np.lexsort((np.arange(total), -full))[:20]
        assert shard.search(query, 20) == [(int(i), int(full[i])) for i in order if full[i] > 0]


def test_odd_rows(spark, edge_docs, no_docs):
    items = [(1, "abc password SECRET ünïcode"), (1, "abc password SECRET ünïcode"), (None, "é"), (2, None), (3, ""), (4, "zzzz9"), (5, words(300, 1)), (6, "x 1 0")]
    frame = spark.createDataFrame([(*r, 7) for r in items], ITEMS)
    assert in_order(collected(R.ranked(edge_docs, frame))) == in_order(brute(texts_of(edge_docs), items))
    assert collected(R.ranked(no_docs, frame)) == [] and collected(R.ranked(edge_docs, frame.limit(0))) == []
    equal = spark.createDataFrame([(i % 9 or None, "one two three", 1, 1, "") for i in range(30)] + [(5, None, 1, 1, "")], DOCS)
    assert in_order(collected(R.ranked(equal, frame.limit(0).union(spark.createDataFrame([(8, "two four", 0)], ITEMS))))) == in_order(brute(texts_of(equal), [(8, "two four")]))


def test_query_blocks_change_nothing(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = read(spark, folder, "documents"), read(spark, folder, "benchmark")
    assert in_order(collected(R.ranked(docs, items, query_terms=900))) == in_order(collected(R.ranked(docs, items)))
