import duckdb
from conftest_llm import collected

from tallyframe.llm import mixing as M
from tallyframe.llm.tables import read


def by_sql(docs):
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841  read by the query
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    return con.execute(M.OP4_SQL).fetchall()


def key(r):
    return tuple((v is None, v or 0) for v in r)


def test_against_sql(spark, edge_docs):
    for docs in (edge_docs, read(spark, "/root/testdata/sf0.001", "documents")):
        got = M.mix(docs)
        assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
        assert sorted(collected(got), key=key) == sorted(by_sql(docs), key=key)


def test_targets_are_met_and_stop_at_three_times(spark):
    rows = [(i, " ".join("w" * (1 + i % 5)) if i % 7 else None, f"s{i % 40 % 9}") for i in range(3000)]
    rows += [(9000 + i, "one two three", "rare") for i in range(4)] + [(9100, "", "none"), (9101, "a b", None)]
    got = collected(M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    source = {r[0]: r[2] for r in rows}
    sums, targets, sizes, longest = {}, {}, {}, {}
    for doc, size, source_size, target, taken in got:
        s = source[doc]
        assert 0 <= taken <= 3 * size and (size == 0 or taken % size == 0)
        sums[s] = sums.get(s, 0) + taken
        targets[s], sizes[s], longest[s] = target, source_size, max(size, longest.get(s, 0))
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    for s, target in targets.items():
        assert target <= 3 * sizes[s] and abs(sums[s] - target) <= longest[s] / 2 + 1e-9
    assert targets["rare"] == 36 and targets["none"] == 0 and sums["rare"] == 36


def test_larger_targets_hold_the_documents_of_smaller_ones(spark):
    found = []
    for others in (100, 700, 1500, 5000):
        rows = [(i, "a b c d", "x") for i in range(900)] + [(5000 + i, "a b", "y") for i in range(others)]
        sized = spark.createDataFrame(rows, "doc_id long, text string, source string").select(
            "source", M.words().alias("size"), M.hash_of("doc_id").alias("hash")
        )
        row = M.plan(sized).filter("source = 'x'").first()
        found.append((row["target"], row["whole"], row["limit"]))
    assert sorted(found) == sorted(found, key=lambda r: r[1:])


def test_stage_takes_rounds_and_keeps_columns(spark, edge_docs, no_docs):
    staged = M.mixing_stage(spark, edge_docs, "")
    assert staged.columns == edge_docs.columns and staged.dtypes == edge_docs.dtypes
    want = {}
    for doc, size, _, _, taken in collected(M.mix(edge_docs)):
        if size:
            want[doc] = want.get(doc, 0) + taken // size
    got = {}
    for r in staged.collect():
        if r["text"] and r["text"].strip(" \t\n\x0b\x0c\r"):
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert M.mixing_stage(spark, no_docs, "").count() == 0 and collected(M.mix(no_docs)) == []
