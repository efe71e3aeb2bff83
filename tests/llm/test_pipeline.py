import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import test_chosen_path
import test_packing
from conftest_llm import collected, edge_texts, texts_of, words

import corpus_pipeline
from tallyframe import session
from tallyframe.llm import mixing
from tallyframe.llm.tables import read, written

REPO = Path(__file__).parents[2]


def line_brute(rows):
    """Texts without the lines that five documents share, except in the largest id."""
    holders = {}
    for i, (_, text) in enumerate(rows):
        for line in text.split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r")
            if len(key) >= 40:
                holders.setdefault(key.encode().lower(), set()).add(i)
    top = {k: max(rows[i][0] for i in v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for doc, text in rows:
        kept = [x for x in text.split("\n") if doc >= top.get(x.strip(" \t\n\x0b\x0c\r").encode().lower(), doc)]
        out.append((doc, "\n".join(kept)))
    return out


def staged_brute(docs, staged):
    """Hold each stage against a plain version on the stage's own input."""
    before = docs
    for (name, _), after in zip(corpus_pipeline.STAGES, staged):
        old = [(r["doc_id"], r["text"]) for r in before.collect()]
        if name == "language":
            known = [r for r in old if r[1] is not None and any(map(str.isalpha, r[1]))]
            assert Counter(texts_of(after)) == Counter(known)
        elif name == "lines":
            assert Counter(texts_of(after)) == Counter(line_brute(old))
        elif name == "near_duplicates":
            classes = {}
            for (doc, text), (_, label, _) in zip(sorted(old, key=str), test_chosen_path.brute(sorted(old, key=str))):
                classes.setdefault(label if test_chosen_path.grams(text) else ("alone", doc, text), []).append(doc)
            assert Counter(d for d, _ in texts_of(after)) == Counter(min(v) for v in classes.values())
        elif name == "mixing":
            documents = before.select("doc_id", "text", "source").toPandas()  # noqa: F841  read by the query
            con = duckdb.connect()
            con.register("documents", documents)
            want = Counter()
            for doc, size, _, _, taken in con.execute(mixing.OP4_SQL).fetchall():
                want[doc] += taken // size if size else 0
            assert Counter(d for d, t in texts_of(after) if t.strip()) == +want
        else:
            test_packing.check_pieces(collected(after), old)
        before = after


def test_every_stage_against_brute_force(spark):
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(edge_texts())]
    shared = "This very line stands in many of the documents, word for word."
    rows += [(100 + i, words(30, 40 + i % 9) + "\n" + shared, "en", "s1", 9) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    staged = []
    for _, stage in corpus_pipeline.STAGES:
        staged.append(written(stage(spark, staged[-1] if staged else docs, ""), "test-stage"))
        if len(staged) < len(corpus_pipeline.STAGES):
            assert staged[-1].columns == docs.columns and staged[-1].dtypes == docs.dtypes
    staged_brute(docs, staged)


def test_run_over_documents(spark):
    folder = "/root/testdata/sf0.001"
    first = collected(corpus_pipeline.run(spark, folder))
    ids = {r["doc_id"] for r in read(spark, folder, "documents").collect()}
    assert first and {r[0] for r in first} <= ids


def test_run_keeps_the_last_stages_input_only(spark):
    with session.owned(spark):
        before = set(session._made)
        rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
        left = [p for p in session._made if p not in before]
        assert len(left) == 1 and "stage-mixing" in left[0] and rows.count() > 0
    assert set(session._made) == before


def test_empty_table(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_the_rest_does_without_this_package(tmp_path):
    """The entry module still offers the other queries when the folders are not there."""
    for name in ("tallyframe", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith("py") else None
    package = tmp_path / "tallyframe"
    package.mkdir()
    for part in (REPO / "tallyframe").iterdir():
        if part.name != "llm":
            (package / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split()[1:] == ["False", "True"], done.stderr
