import random
import re

import duckdb
from conftest_llm import collected
from pyspark.sql import functions as F

from tallyframe.llm import urls as U
from tallyframe.llm.tables import read

PAGES = "page_id long, url string, host string, key string, block int"


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def canonical(url):
    host, path = parts(url)
    host_ = re.sub(r"^(www|m)\.", "", re.sub(r":[0-9]*\Z", "", re.sub(r"(?s)^.*@", "", host)))
    return host_ + re.sub(r"/+\Z", "", path) if host else None


def brute(pages, rules, listed):
    listed, out = set(listed) - {None}, []
    for page, url in pages:
        host, path = parts(url)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        fits = [(*f[:3], max(v for *k, v in fits if k == list(f[:3]))) for f in fits]
        rule, verdict = max(fits)[2:] if fits else (None, "block" if canonical(url) in listed else "allow")
        out.append((page, host, path, rule, verdict))
    return out


def key(row):
    return tuple((v is None, v or 0 if not isinstance(v, str) else v) for v in row)


def by_sql(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    return con.execute(U.OP12_SQL).fetchall()


def test_query_against_sql_and_brute_force(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/check_h"):
        got = collected(U.op12_url_filter(spark, folder))
        assert sorted(got, key=key) == sorted(by_sql(folder), key=key)
        pages = [tuple(r) for r in read(spark, folder, "pages").select("page_id", "url").collect()]
        sites = [canonical(u) for _, u in pages if set(re.split(r"[.\-]", parts(u)[0])) & set(U.SITE_WORDS)]
        assert sorted(got, key=key) == sorted(brute(pages, U.RULES, sites), key=key)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"} and len({r[3] for r in got}) == 6


def edge_pages():
    urls = [
        None, "", "no scheme", "://", "http://", "http:///en/1", "HTTP://A.Example.ORG/en/1?x=://b", "http://example.org", "http://example.org?x/es/",
        "http://myexample.org/es/", "http://x.example.org/es/a#b", "https://org/", "https://org", "ftp://u:p@b.com:80/fr/", "http://b.com/FR/", "http://b.com/de/\n/x",
        "http://a." * 1, "http://" + "a." * 3000 + "com/de/" + "x" * 100_000, "http://É.org/é", "a://b://c.com/fr/", "http://www.m.b.com/de", "http://b.com//",
    ]
    return [(i, u) for i, u in enumerate(urls)] + [(5, "http://b.com/de/")] * 4 + [(None, "http://b.com/fr/x")] * 3 + [(None, None)] * 2


def test_odd_urls_and_lists(spark):
    pages = edge_pages()
    frame = spark.createDataFrame([(*p, "h", "k", 1) for p in pages], PAGES).repartition(3)
    rules = [*U.RULES, ("b.com", "/", "block"), ("b.com", "/", "allow"), (None, "/", "block"), ("COM", "", "block"), ("x.example.org", "/", "allow"), ("org", "/", "allow")]
    listed = [canonical(u) for _, u in pages[:12]] + [None, "b.com", "b.com", "É.org/é"]
    clean = [(h.lower(), p, v) for h, p, v in rules if h]
    wanted = sorted(brute(pages, clean, listed), key=key)
    listed_ = spark.createDataFrame([(u, 1) for u in listed], "url string, verdict int")
    rules_ = spark.createDataFrame([(*r, 3) for r in rules], U.RULE_SCHEMA + ", block int")
    assert sorted(collected(U.judged(frame, rules_, listed_)), key=key) == wanted
    assert sorted(collected(U.judged(frame, rules_.limit(0), listed_.limit(0))), key=key) == sorted(brute(pages, [], []), key=key)
    assert collected(U.judged(frame.limit(0), rules_, listed_)) == []


def test_a_full_filter_changes_nothing(spark):
    rng = random.Random(1)
    pages = [(i, f"http://s{rng.randint(0, 40)}.net/p{rng.randint(0, 200)}/") for i in range(3000)]
    listed = sorted({canonical(u) for _, u in rng.sample(pages, 700)})
    frame, listed_ = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(u,) for u in listed], "url string")
    rules = spark.createDataFrame([("s1.net", "/p1", "allow")], U.RULE_SCHEMA)
    wanted = sorted(brute(pages, [("s1.net", "/p1", "allow")], listed), key=key)
    for most in (1, 1 << 20):
        assert sorted(collected(U.judged(frame, rules, listed_, most)), key=key) == wanted


def test_filter_passes_all_listed_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    filter_, blocks = U.bloom(keys, 20_000)
    assert blocks == -(-20_000 * U.BITS_A_KEY // U.BLOCK_BITS)
    assert U.passing(keys, filter_, blocks).count() == 20_000
    others = spark.range(100_000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert U.passing(others, filter_, blocks).count() < 2_000


def test_built_in_functions_only(spark):
    plan = U.op12_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn", plan)
