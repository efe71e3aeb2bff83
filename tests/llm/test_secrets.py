import hashlib
import math
import random
import re
from collections import Counter

import pytest
from conftest_llm import collected, texts_of, words
from pyspark.sql import functions as F

from tallyframe.llm import secrets as S
from tallyframe.llm.tables import read


def base(text):
    text, out = text or "", []
    for k, (pattern, enough) in enumerate([
        (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]):
        out.append([(m.start(), k, m.end()) for m in re.finditer(pattern, text) if enough(m)])
    spans = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(sum(out, [])))
    return (*map(len, out), hashlib.sha256(spans.encode()).hexdigest(), spans)


def test_base_spans_against_regular_expressions(spark, edge_docs):
    for docs in (edge_docs, read(spark, "/root/testdata/sf0.01", "documents")):
        rows = collected(S.scan(docs))
        assert len(rows) == docs.count()
        want = sorted(str((d, *base(t)[:4])) for d, t in texts_of(docs))
        assert sorted(str(r[:5]) for r in rows) == want
        texts = dict(texts_of(docs))
        for doc, *_, spans in rows:
            known = [s for s in base(texts[doc])[4].split(",") if s]
            assert set(known) <= set(spans.split(","))


def test_battery_finds_random_tokens_and_leaves_words(spark):
    rng = random.Random(3)
    signs = S.ENCODINGS[5][1]
    rows = [(i, "see " + "".join(rng.choice(signs) for _ in range(44)) + " there") for i in range(120)]
    rows += [(1000 + i, "see " + "".join(rng.choice(["keit", "lich", "ung", "heit", "ver", "schen"]) for _ in range(9)) + " there") for i in range(120)]
    got = {r[0]: r[5] for r in collected(S.scan(spark.createDataFrame(rows, "doc_id long, text string")))}
    found = [d for d, spans in got.items() if "random:" in spans]
    assert len([d for d in found if d < 1000]) > 90 and not [d for d in found if d >= 1000]
    assert got[found[0]] == "random:4:48"


def random_spans(spark, tokens):
    rows = [(i, f"see {token} there") for i, token in enumerate(tokens)]
    return [f"random:4:{4 + len(tokens[d])}" in spans for d, *_, spans in sorted(collected(S.scan(spark.createDataFrame(rows, "doc_id long, text string"))))]


def test_lone_and_few_random_tokens_are_found(spark):
    rng = random.Random(11)
    draw = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    for signs, n in ((S.ENCODINGS[5][1], 44), (S.ENCODINGS[2][1], 32), (S.ENCODINGS[1][1], 40)):
        for many in (1, 2, 5):
            assert all(random_spans(spark, [draw(signs, n) for _ in range(many)]))


def test_random_tokens_are_found_whatever_shares_their_class(spark):
    rng = random.Random(12)
    keys = ["".join(rng.choice(S.ENCODINGS[5][1]) for _ in range(44)) for _ in range(300)]
    syllables = ["get", "User", "name", "From", "table", "Count", "Index", "read", "List", "verlich", "heit"]
    names = ["/".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(4))[:44] for _ in range(600)]
    alone, among = random_spans(spark, keys), random_spans(spark, keys + names)
    assert alone == among[:300] and sum(alone) >= 297
    assert not any(among[300:])


def test_ordinary_tokens_that_pass_the_battery_are_left(spark):
    # ten and more tokens of one class at p >= 0.5 were let through whatever they are
    names = ["__GetRawExtensionKeys", "TYPE_PARAMS_OF_ListOrSet", "DOM2-Traversal-Range", "nameset-DOT_ATOM_ENDS"] * 3
    assert not any(random_spans(spark, names))


def test_empty_table(no_docs):
    assert collected(S.scan(no_docs)) == []


def test_no_python_on_the_main_path(spark, capsys):
    S.op9_secret_scan(spark, "/root/testdata/sf0.001").explain()
    assert "Python" not in capsys.readouterr().out


def tail(z):
    """Share of a standard normal above z."""
    return math.erfc(z / math.sqrt(2)) / 2


def battery(token):
    """Encoding and the joint p-value as uniform draws, from the definitions of the three tests."""
    name, letters = next((n, a) for n, a in S.ENCODINGS if set(token) <= set(a))
    v, k, n = [letters.index(c) for c in token], len(letters), len(token)
    chi = 0.0
    for b in range(8):
        inside = [x for x in range(k) if x * 8 // k == b]
        expected = n * len(inside) / k
        chi += (sum(x in inside for x in v) - expected) ** 2 / expected
    p1 = tail(((chi / 7) ** (1 / 3) - (1 - 2 / 63)) / math.sqrt(2 / 63))
    high = [x >= k / 2 for x in v]
    above, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * above * (n - above) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p2 = 2 * tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    middle = sum(v) / n
    square, cross = sum((x - middle) ** 2 for x in v), sum((a - middle) * (b - middle) for a, b in zip(v, v[1:]))
    p3 = 2 * tail(abs(cross / square + 1 / n) * math.sqrt(n)) if square > 0 else 0.0
    return name, min(1, 3 * max(min(p1, p2, p3), 1e-12))


def tokens_of_all_kinds(n, seed):
    rng = random.Random(seed)
    draw = lambda signs, long: "".join(rng.choice(signs) for _ in range(long))
    out = [draw(rng.choice(S.ENCODINGS)[1], rng.randint(20, 90)) for _ in range(n)]
    return out + [draw(rng.choice(["ab", "abcdefghij", "XYZ", "0123456789", "thelandofa"]), rng.randint(20, 60)) for _ in range(n)] + ["a" * 30, "0" * 20 + "f" * 20]


def test_battery_against_its_definition(spark):
    tokens = tokens_of_all_kinds(150, 21)
    model = S.fitted(spark.createDataFrame([("some plain words",)], "text string"))
    frame = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = frame.select("t", S.battery(F.col("t"), model).alias("b")).select("t", "b.*").collect()
    for r in got:
        name, p = battery(r["t"])
        assert r["name"] == name and r["long"] == int(math.log2(len(r["t"])))
        assert -r["apart"] == pytest.approx(math.log(p), abs=0.05)


def test_uniform_draws_have_uniform_p_values(spark):
    rng = random.Random(22)
    rows = [("".join(rng.choice(S.ENCODINGS[5][1]) for _ in range(44)),) for _ in range(3000)]
    model = S.fitted(spark.createDataFrame([], "text string"))
    apart = [r[0] for r in spark.createDataFrame(rows, "t string").select(S.battery(F.col("t"), model)["apart"]).collect()]
    for share in (0.5, 0.1, 0.01):
        assert 0.6 * share < sum(a > -math.log(share) for a in apart) / len(apart) < 1.5 * share
    assert sum(a > -math.log(S.DROPPED_SHARE) for a in apart) < 5


def model_of(texts):
    """Turns and signs counted over different words, straight from the definition."""
    counts = Counter(S._prior())
    kind = lambda c: next(k for k, letters in enumerate(S.SORTS) if c in letters)
    for word in {w for t in texts for w in re.findall("[A-Za-z0-9+/_-]+", t or "") if len(w) < S.LEAST}:
        before = len(S.SORTS)
        for c in word:
            counts[before, c] += 1
            before = kind(c)
    turns, signs = {}, {}
    for (before, c), n in counts.items():
        turns[before, kind(c)] = turns.get((before, kind(c)), 0) + n
        signs[c.lower()] = signs.get(c.lower(), 0) + n
    return turns, signs, kind


def test_the_ordinary_model_is_fitted_to_the_table(spark, edge_docs, no_docs):
    for docs in (edge_docs, read(spark, "/root/testdata/sf0.01", "documents"), no_docs):
        texts = [t for _, t in texts_of(docs)]
        turns, signs, kind = model_of(texts)
        got_turns, got_signs = S.fitted(docs.select(F.coalesce("text", F.lit("")).alias("text")))
        for a in range(7):
            whole = sum(turns.get((a, b), 0) for b in range(6))
            for b in range(6):
                assert got_turns[a * 6 + b] == pytest.approx(-math.log((turns.get((a, b), 0) + 1) / (whole + 6)))
        for c, cost in zip(S.SIGNS, got_signs):
            whole = sum(n for x, n in signs.items() if kind(x) == kind(c.lower()))
            assert cost == pytest.approx(-math.log((signs.get(c.lower(), 0) + 1) / (whole + len(S.SORTS[kind(c.lower())]))))
        assert sum(math.exp(-x) for x in got_turns[:6]) == pytest.approx(1)


def test_odds_against_ordinary_tokens(spark):
    model = S.fitted(read(spark, "/root/testdata/sf0.001", "documents").select("text"))
    turns, signs = model
    tokens = tokens_of_all_kinds(60, 23)
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", S.battery(F.col("t"), model).alias("b")).select("t", "b.*").collect()
    for r in rows:
        cost, before = 0.0, len(S.SORTS)
        for c in r["t"]:
            k = next(k for k, letters in enumerate(S.SORTS) if c in letters)
            cost += turns[before * 6 + k] + signs[S.SIGNS.index(c)]
            before = k
        uniform = len(r["t"]) * math.log(len(dict(S.ENCODINGS)[r["name"]])) + math.log(len(S.ENCODINGS))
        assert r["weight"] == pytest.approx(max(0.0, cost - uniform))


@pytest.mark.parametrize("share", [0.1, 1e-4])
def test_thresholds_against_the_rule_itself(spark, share):
    rng = random.Random(24)
    rows = [("hex", 4, rng.expovariate(1), i) for i in range(300)] + [("hex", 4, rng.uniform(5, 40), 1000 + i) for i in range(40)]
    rows += [("mixed", 5, rng.expovariate(1), i) for i in range(200)] + [("base32", 4, 9.5, 7)] * 3 + [("base36", 6, 400.0, 1), ("base36", 6, 0.0, 2)]
    got = S.thresholds(spark.createDataFrame(rows, "name string, long int, weight double, key long"), false_share=share).first()[0]
    for name, long in {r[:2] for r in rows}:
        of = {r[3]: r[2] for r in rows if r[:2] == (name, long)}
        # p-values in whole units of -log p; the largest p for which m p <= share x tokens at or below it
        least = [c for c in range(1, S.CELLS) if len(of) * math.exp(-c) <= share * sum(min(int(w), S.CELLS - 1) >= c for w in of.values())]
        assert got.get(f"{name}/{long}") == (min(least) if least else None)


def test_random_tokens_stay_among_ordinary_ones_that_are_ruled_out(spark):
    rng = random.Random(25)
    keys = ["".join(rng.choice(S.ENCODINGS[4][1]) for _ in range(40)) for _ in range(400)]
    plain = [words(8, 3000 + i, "etaoinshrdlu").replace(" ", "")[:40].ljust(40, "e") for i in range(1200)]
    found = random_spans(spark, keys + plain)
    assert sum(found[:400]) >= 396 and not any(found[400:])
