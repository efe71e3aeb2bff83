import gzip
import hashlib
import random

from conftest_llm import collected

from tallyframe.llm import warc as W
from tallyframe.llm.tables import read
from tallyframe.session import new_path

PAGES = "page_id long, url string, html string, first long, of string"


def pages(spark):
    rows = [(i, f"http://x/é {i}\r\n", f"<p>page {i % 7} ü🙂</p>\r\n\r\nWARC/1.1 " * (i % 4), None, "x") for i in range(60)]
    rows += [(100, None, None, 1, None), (101, "u", "", 1, None), (None, "u", "null id", 1, None), (None, "u", "", 1, None)]
    rows += [(59, "u", rows[59][2], None, None), (200, "v", "\x00" * 70000, None, None), (None,) * 5]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def expected(rows):
    largest, count = {}, {}
    for page, html in rows:
        html = html or ""
        count[html] = count.get(html, 0) + 1
        if page is not None:
            largest[html] = max(page, largest.get(html, page))
    out = []
    for page, html in rows:
        data, top = (html or "").encode(), largest.get(html or "")
        again = count[html or ""] > 1 and top is not None and page != top
        out.append((page, len(data), W.digest(data), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def round_trip(spark, df):
    path = new_path(spark, "test-warc")
    W.write_archives(df, path, file_records=7)
    return W.read_archives(spark, path).collect()


def test_round_trip(spark):
    for df in (pages(spark), read(spark, "/root/testdata/sf0.001", "pages")):
        rows = round_trip(spark, df)
        assert all(r["kind"] == "record" for r in rows)
        got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)
        assert got == expected([(r["page_id"], r["html"]) for r in df.collect()])
        texts = {(r["html"] or "").encode() for r in df.collect()}
        assert {bytes(r["payload"]) for r in rows if r["record_type"] == "response"} == texts
    assert round_trip(spark, spark.createDataFrame([], PAGES)) == []


def test_query(spark):
    rows = collected(W.op3_warc(spark, "/root/testdata/sf0.001"))
    docs = read(spark, "/root/testdata/sf0.001", "pages").collect()
    assert sorted(rows, key=str) == expected([(r["page_id"], r["html"]) for r in docs])


def archive(n, zipped):
    made = [W.record(i, f"http://x/{i}", (f"body {i} " * (i + 1)).encode(), None, False) + W.END for i in range(n)]
    return [gzip.compress(m) for m in made] if zipped else made


def test_salvage_recovers_what_is_sound():
    rng = random.Random(43)
    for zipped in (False, True):
        for _ in range(60):
            parts = archive(12, zipped)
            hurt = sorted(rng.sample(range(12), 3))
            for i in hurt:
                way, p = rng.randrange(4), parts[i]
                at = rng.randrange(len(p))
                parts[i] = [p[:at], p[:at] + bytes([p[at] ^ 0x55]) + p[at + 1 :], b"junk" + p[5:], p[: at // 2] + b"\x00" * 9 + p[at:]][way]
            data = b"".join(parts)
            found = list(W.salvaged(data))
            ids = [f["page_id"] for kind, *_, f in found if kind == "record"]
            # a sound record is lost only if the cut before it left no start for it, which cannot happen
            assert set(range(12)) - set(hurt) <= set(ids)
            assert sum(length for _, _, length, _, _ in found) == len(data)
            at = 0
            for _, start, length, reason, _ in found:
                assert start == at
                at += length
            assert all(reason for kind, _, _, reason, _ in found if kind == "gap")


def test_junk_alone():
    assert [r[:3] for r in W.salvaged(b"no archive")] == [("gap", 0, 10)] and list(W.salvaged(b"")) == []
    assert [r[0] for r in W.salvaged(b"".join(archive(2, False))[:-3])] == ["record", "gap"]


def test_very_long_urls_and_urls_that_end_in_a_version_line(spark, monkeypatch):
    rows = [(1, "http://x/" + "\u6f22" * 30000, "a"), (2, "http://x/WARC/1.0", "b"), (3, "http://x/WARC/1.1", "c"), (4, "WARC/1.1", "a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r["kind"], r["page_id"]) for r in round_trip(spark, df)) == [("record", i) for i in (1, 2, 3, 4)]
    monkeypatch.setattr(W, "read", lambda *_: df)
    assert sorted(r[0] for r in collected(W.op3_warc(spark, ""))) == [1, 2, 3, 4]


def test_a_url_that_runs_into_another_record_is_damage():
    one, two = archive(2, False)
    cut = one.index(b"http://x/0") + 8
    found = list(W.salvaged(one[:cut] + two + one))
    # the cut record's id must not be given to the page behind it
    assert [(f[0], f[4].get("page_id")) for f in found] == [("gap", None), ("record", 1), ("record", 0)]


def test_query_fails_when_a_written_page_is_not_read(spark, monkeypatch):
    import pytest

    path = new_path(spark, "test-warc-gap")
    W.write_archives(pages(spark), path)
    spark.createDataFrame([("no archive",)], "value string").coalesce(1).write.mode("append").text(path)
    monkeypatch.setattr(W, "new_path", lambda *_: path)
    monkeypatch.setattr(W, "write_archives", lambda *_: None)
    with pytest.raises(Exception, match="gap in a written archive"):
        W.op3_warc(spark, "/root/testdata/sf0.001").collect()


def test_query_with_revisits(spark, tmp_path):
    """Payloads that pages share, over a whole table: the largest page is the response, all others refer to it."""
    rows = [(i, f"http://a.org/{i}", f"page {i % 7}" * (i % 7)) for i in range(200)]
    rows += [(300 + i, None, None if i % 2 else "") for i in range(9)] + [(400 + i, "u", f"alone {i}") for i in range(20)]
    rows += [(500, "u", "twice"), (500, "u", "twice"), (None, "u", "twice"), (None, "u", "only without id"), (None, "u", "only without id")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sum string, first int")
    frame.repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    key = lambda r: tuple((v is not None, v or 0 if not isinstance(v, str) else v) for v in r)
    first, want = {}, []
    for page, _, html in rows:
        payload = (html or "").encode()
        first[payload] = max(first.get(payload, -1), -1 if page is None else page)
    for page, _, html in rows:
        payload = (html or "").encode()
        again = first[payload] >= 0 and page != first[payload]
        sha = W.base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((page, len(payload), sha, "revisit" if again else "response", first[payload] if again else None))
    got = [tuple(r) for r in W.op3_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[3] == "revisit" for r in got) > 180


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(W, "SMALL_PAGE", 1000)
    sizes = [10] * 60 + [1500] * 30 + [7000] * 9 + [40_000] * 3 + [200_000]
    rows = [(i, "http://a.org/" + "é" * (i % 50), chr(97 + i % 26) * n + str(i)) for i, n in enumerate(sizes)]
    path = f"{tmp_path}/archives"
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path, file_records=16)
    files = [os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-")]
    head = 1500  # of a record
    assert max(files) < 210_000 and sorted(files)[-2] < max(16 * (1000 + head), 40_000 + 2 * head) + 1000
    found = W.read_archives(spark, path).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in found) == [(i, h) for i, _, h in rows]
