import zlib

import numpy as np
from conftest_llm import collected

from tallyframe.llm import language as L
from tallyframe.llm.tables import read


def test_gradients_against_differences():
    net = L.Network(["x", "y", "z"], seed=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(5)
    x, y = rng.integers(97, 101, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grad = net.gradients(x, y)
    for name, where in (("xf", (98, 3)), ("xf", (98, 20)), ("uf", (2, 5)), ("ub", (3, 12)), ("vb", (1, 4)), ("of", (2, 1)), ("c", (0,))):
        keep = net.w[name][where]
        ends = []
        for step in (1e-3, -1e-3):
            net.w[name][where] = keep + step
            ends.append(net.gradients(x, y)[0])
        net.w[name][where] = keep
        assert abs((ends[0] - ends[1]) / 2e-3 - grad[name][where]) < 1e-3, name


def test_windows_side_by_side_equal_one_text_at_a_time():
    net = L.Network(["x", "y"], seed=3)
    texts = ["abc", "", None, "12 !", "word " * 200, "é", "q" * 129]
    together = list(net.predict(enumerate(texts)))
    alone = [next(iter(net.predict([(i, t)]))) for i, t in enumerate(texts)]
    assert [r[:2] for r in together] == [r[:2] for r in alone]
    assert np.allclose([r[2] for r in together], [r[2] for r in alone], atol=1e-4)
    assert [r[1] for r in together][1:4] == ["und"] * 3


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = collected(L.op8_language_id(spark, "/root/testdata/sf0.01"))
    assert len(rows) == docs.count()
    assert all(out == (zlib.crc32(str(doc).encode()) % 4 == 2) for doc, out, _, _ in rows)
    asked = [(lang, truth[doc]) for doc, out, lang, _ in rows if out and truth[doc] is not None and lang != "und"]
    assert sum(a == b for a, b in asked) / len(asked) > 0.97


def test_edge_cases(spark, edge_docs, no_docs):
    net = L.train(edge_docs, per_language=5)
    rows = collected(L.predicted(edge_docs, net))
    assert len(rows) == edge_docs.count() and {r[2] for r in rows} <= {"en", "fr", "und"}
    assert all(0 <= r[3] <= 1 for r in rows)
    kept = L.keep_known(edge_docs, net)
    assert kept.columns == edge_docs.columns and kept.dtypes == edge_docs.dtypes
    assert all(any(map(str.isalpha, r["text"])) for r in kept.collect())
    assert collected(L.predicted(no_docs, L.train(no_docs))) == []
    assert L.keep_known(no_docs, net).count() == 0
