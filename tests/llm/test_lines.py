import duckdb
import numpy as np
from conftest_llm import collected, words

from tallyframe.llm import lines as L
from tallyframe.llm.tables import read


def by_sql(docs):
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841  read by the query
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    return con.execute(L.OP6_SQL).fetchall()


def repeated(spark):
    shared = ["Shared line number one, which is long enough to count.", "  ÄNOTHER Shared LINE that is also long enough é\t"]
    rows = [(i, words(8, i) + "\n" + shared[i % 2] + "\n" + words(9, 50 + i) + ("\n" + shared[0].upper() if i % 3 else "\r")) for i in range(14)]
    rows += [(None, shared[0]), (3, shared[1] + "\n" + shared[1]), (77, None), (78, ""), (79, "\n")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_sql(spark, edge_docs, no_docs):
    for docs in (repeated(spark), edge_docs, read(spark, "/root/testdata/sf0.01", "documents")):
        got = collected(L.line_digest(docs))
        assert sorted(got, key=str) == sorted(by_sql(docs), key=str)
    assert any(r[2] for r in collected(L.line_digest(repeated(spark))))
    assert collected(L.line_digest(no_docs)) == []


def test_filter_inserts_deletes_and_grows():
    keys = [L.xxhash.xxh3_128_digest(str(i)) for i in range(5000)]
    made = L._filter_of(keys[:3000])
    assert made.holds(keys[:3000]).all() and made.holds(keys[3000:]).mean() < 0.01
    made.delete(keys[:1500])
    assert made.holds(keys[1500:3000]).all() and made.holds(keys[:1500]).mean() < 0.01
    assert L.CuckooFilter.from_bytes(made.to_bytes()).holds(keys[1500:3000]).all()
    small = L.CuckooFilter(4)
    assert not small.insert(keys)


def state_of(state):
    drops = {(r["loser"], tuple(sorted(map(bytes, r["keys"])))) for r in L.dropped(state).collect()}
    counts = {(bytes(r["key"]), r["n_docs"], r["keeper"]) for r in state.counts.collect()}
    return drops, counts


def test_deleting_takes_an_insertion_back(spark):
    docs = repeated(spark)
    some, rest = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1 and doc_id <> 3")
    first = L.build(some)
    both = L.insert(first, rest)
    assert state_of(both) == state_of(L.build(some.union(rest)))
    assert state_of(both) != state_of(first)
    assert state_of(L.delete(both, rest)) == state_of(first)


def keys_in_filters(state, keys):
    made = {r["shard"]: L.CuckooFilter.from_bytes(bytes(r["data"])) for r in state.filters.collect()}
    return {k for k in keys if (s := L.shard_of(k, state.shards)) in made and made[s].holds([k])[0]}


def test_many_steps_equal_one_build(spark):
    """Filters that grow and shrink, keepers that go, ids that come back; counts and filters as if built at once."""
    shared = [f"A line that {i} many documents have in common, more or less." for i in range(600)]
    rows = [(i, "\n".join(shared[k] for k in range(600) if (k * 7 + i) % (3 + k % 9) == 0 or k < i)) for i in range(40)] + [(None, shared[0])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    part = lambda rule: docs.filter(rule)
    state = L.build(part("doc_id < 4"), shards=3)
    state = L.insert(state, part("doc_id >= 4 or doc_id is null"))
    assert state_of(state) == state_of(L.build(docs, shards=3))
    state = L.delete(state, part("doc_id > 20 or doc_id % 5 = 0 or doc_id is null"))
    rule = "doc_id <= 20 and doc_id % 5 <> 0"
    assert state_of(state) == state_of(L.build(part(rule), shards=3))
    state = L.compacted(L.insert(state, part("doc_id > 30 and doc_id % 2 = 0")))
    fresh = L.build(part(f"({rule}) or (doc_id > 30 and doc_id % 2 = 0)"), shards=3)
    assert state_of(state) == state_of(fresh)
    keys = [L.line_key(line) for line in shared]
    often = {bytes(r["key"]) for r in state.counts.filter("n_docs >= 5").collect()}
    assert often <= keys_in_filters(state, keys) and len(keys_in_filters(state, keys) - often) < 5
    assert L.delete(state, docs).counts.count() == 0 and collected(L.dropped(L.delete(state, docs))) == []


def test_a_deletion_writes_the_keys_of_its_documents_only(spark, monkeypatch):
    rows = [(i, "\n".join(f"line {i} {k} of a document, which is long enough to count" for k in range(50))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    state = L.build(docs)
    sizes = []
    monkeypatch.setattr(L, "written", lambda df, label: sizes.append((label, (out := L_written(df, label)).count())) or out)
    gone = L.delete(state, docs.filter("doc_id = 7"))
    assert dict(sizes) == {"line-gone": 1, "line-touched": 50, "line-filters": 0}
    assert gone.counts.count() == 29 * 50


L_written = L.written


def test_shards_share_no_bits_with_buckets():
    keys = [k for i in range(60_000) if L.shard_of(k := L.xxhash.xxh3_128_digest(str(i)), 64) == 5]
    made = L.CuckooFilter(1 << 23)
    _, first, second = made._where(made.numbers(keys))
    assert len(made.table) == 1 << 22
    for at in (first, second):  # a shard's keys lie in all parts of a large filter alike
        assert np.bincount((at >> np.uint64(16)).astype(int), minlength=64).min() > len(keys) / 64 / 4


def test_stage_keeps_rows_and_columns(spark, edge_docs, no_docs):
    docs = repeated(spark).selectExpr("doc_id", "text", "0 as n_chars", "'x' as keys", "1 as loser")
    staged = L.line_stage(spark, docs, "")
    assert staged.columns == docs.columns and staged.dtypes == docs.dtypes and staged.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in staged.collect() if r["text"] is not None)
    assert L.line_stage(spark, edge_docs, "").count() == edge_docs.count()
    assert L.line_stage(spark, no_docs, "").count() == 0
