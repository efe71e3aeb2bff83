"""Secret scan: known forms, and tokens that pass a battery of randomness tests.

Built-in functions only.  Spark gives matches without places, so the pieces between
them are taken as well and the places follow from the running lengths.

Besides the known forms, every token of at least ``LEAST`` letters, digits and ``+/_-``
is a candidate.  Its encoding is the smallest alphabet that holds it.  Three tests ask
whether its symbols could be uniform draws from that alphabet: chi-squared over eight
equal ranges of the alphabet, the number of runs above and below its middle, and the
correlation of neighbours.  The last two depend on each other, so their p-values are joined by
Bonferroni's bound, three times the smallest, which holds under any dependence.

False discoveries are controlled twice, per encoding and length (in powers of two) over the
whole table, by the Benjamini-Hochberg rule; a repeated token counts once, and p-values are
counted in cells of one unit of -log p.

* The battery's p-values: tokens found not to be uniform draws are ruled out.  At most
  ``DROPPED_SHARE`` of those are uniform draws after all, so nearly every random token stays,
  also among very many ordinary ones.
* What stays is weighed against the table's ordinary tokens: a chain of six kinds of symbols
  with a frequency per letter, fitted to all different shorter tokens of all texts (``fitted``).  The
  chance of a token there over its chance as uniform draws is a p-value against ordinary
  tokens, since it is below x with a chance of at most x for them.  The rule at
  ``FALSE_SHARE`` takes the random ones.  A class with one token needs a p-value of ``FALSE_SHARE``
  like any other test, so a lone random key is found; a random token's p-value falls so fast
  with its length that it stays found among many others.

A table too small to show what is ordinary leans on the English text of Python's own help
(``pydoc_data``), which counts as ``PRIOR`` symbols.

Defined cases: a null text is empty and has no spans; an empty text and an empty table
likewise; equal texts get equal spans; a span of the battery that overlaps a known
form is left out; repeated and null ids are kept row by row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.tables import read, whole_text, written

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a whole run or nothing: a later start in the run is shorter
HEX = r"[0-9a-f]{24,}"
LEAST, FALSE_SHARE, DROPPED_SHARE, CELLS, PRIOR = 20, 0.1, 1e-4, 100, 5_000
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + UPPER),
    ("alnum", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", UPPER + LOWER + DIGITS + "+/-_"),
]
SORTS = ["aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", DIGITS, "+/-_"]
SIGNS = "".join(SORTS)
#: The kind of every sign as a digit, and the kind before a token's first sign.
KIND_OF, START = "".join(str(k) * len(letters) for k, letters in enumerate(SORTS)), len(SORTS)
WORD = r"[A-Za-z0-9+/_-]+"


def places(pieces: Column, lengths: Column) -> Column:
    """(start, end) of every match, from the pieces between matches and the matches' lengths."""
    cells = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), lengths.alias("long"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(state: Column, cell: Column) -> Column:
        begin = state["at"] + cell["gap"]
        end = begin + F.coalesce(cell["long"], F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    return F.aggregate(cells, start, add)["out"]


def with_places(df: DataFrame, name: str, pattern: str, keep_groups: int = 0) -> DataFrame:
    """``name``: start, end and text (of group ``keep_groups``) of every match of ``pattern`` in ``text``."""
    df = df.withColumn("__m", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    some = F.size("__m") > 0
    df = df.withColumn("__p", F.when(some, F.split("text", pattern, -1)))
    df = df.withColumn("__g", F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(keep_groups))) if keep_groups else F.col("__m"))
    spans = F.slice(places(F.col("__p"), F.transform("__m", F.length)), 1, F.size("__m"))
    zipped = F.zip_with(spans, F.col("__g"), lambda s, g: F.struct(s["start"].alias("start"), s["end"].alias("end"), g.alias("text")))
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return df.withColumn(name, F.when(some, zipped).otherwise(empty)).drop("__m", "__p", "__g")


def normal_above(z: Column) -> Column:
    """Share of a standard normal above z: a logistic curve good to 2e-4 in the middle, a continued fraction beyond 2."""
    tail = z + 5.0
    for k in (4, 3, 2, 1):
        tail = z + k / tail
    middle = 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))
    return F.when(z > 2, F.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail).otherwise(middle)


def floor_p(p: Column) -> Column:
    return F.greatest(p, F.lit(1e-12))


@cache
def _prior() -> dict[tuple[int, str], float]:
    """Signs by the kind before them in the different words of Python's help texts, ``PRIOR`` of them in all."""
    from pydoc_data.topics import topics

    counts = Counter()
    for word in {w for text in topics.values() for w in re.findall(WORD, text)}:
        kinds = [START, *(int(KIND_OF[SIGNS.index(c)]) for c in word)]
        counts.update(zip(kinds, word))
    return {cell: n * PRIOR / counts.total() for cell, n in counts.items()}


def fitted(texts: DataFrame) -> tuple[list[float], list[float]]:
    """-log of the chance of each kind after each kind (rows; the last for a token's start), and of each sign among its kind.

    Counted over the different tokens of all texts (column text) that are too short to be
    candidates; upper and lower case share the frequencies of letters.  The counts that come to
    the driver are one per kind and sign.
    """
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).filter(F.length("word") < LEAST).distinct()
    words = words.select("word", F.concat(F.lit(str(START)), F.translate("word", SIGNS, KIND_OF)).alias("kinds"))
    at = words.select("word", "kinds", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    cells = at.groupBy(F.substr("kinds", F.col("i"), F.lit(1)).alias("before"), F.substr("word", F.col("i"), F.lit(1)).alias("sign")).count()
    counts = Counter(_prior())
    for row in cells.collect():
        counts[int(row["before"]), row["sign"]] += row["count"]
    kind = lambda c: int(KIND_OF[SIGNS.index(c)])
    after, letters, of_kind = Counter(), Counter(), Counter()
    for (before, sign), n in counts.items():
        after[before, kind(sign)] += n
        letters[sign.lower()] += n
        of_kind[kind(sign.lower())] += n
    turns = [
        -math.log((after[a, b] + 1) / (sum(after[a, k] for k in range(len(SORTS))) + len(SORTS))) for a in range(START + 1) for b in range(len(SORTS))
    ]
    signs = [-math.log((letters[c.lower()] + 1) / (of_kind[kind(c.lower())] + len(SORTS[kind(c.lower())]))) for c in SIGNS]
    return turns, signs


def battery(token: Column, model: tuple[list[float], list[float]]) -> Column:
    """(encoding, length class, -log of the p-value as uniform draws, -log of that against ordinary tokens) of a token."""
    name, alphabet = F.lit("mixed"), F.lit(ENCODINGS[-1][1])
    for label, letters in reversed(ENCODINGS[:-1]):
        inside = F.translate(token, letters, "") == ""
        name, alphabet = F.when(inside, label).otherwise(name), F.when(inside, letters).otherwise(alphabet)
    parts = F.struct(name.alias("name"), alphabet.alias("letters"), token.alias("token"))
    return _let(parts, lambda part: _tests(part, model)).withField("key", F.xxhash64(token))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _tests(part: Column, model: tuple[list[float], list[float]]) -> Column:
    n, k = F.length(part["token"]).cast("double"), F.length(part["letters"]).cast("double")
    symbols = F.transform(F.split(part["token"], ""), lambda c: (F.instr(part["letters"], c) - 1).cast("double"))
    symbols = F.filter(symbols, lambda v: v >= 0)
    # all of an encoding's tokens of one length are equally likely as uniform draws, and each encoding as likely as the others
    odds = ordinary(part["token"], model) - n * F.log(k) - math.log(len(ENCODINGS))
    return _let(F.struct(symbols.alias("v"), n.alias("n"), k.alias("k"), part["name"].alias("name"), odds.alias("odds")), _joint)


def ordinary(token: Column, model: tuple[list[float], list[float]]) -> Column:
    """-log of a token's chance among ordinary tokens of its length."""
    sorts = F.array(*[F.lit(int(k)) for k in KIND_OF])
    turns, costs = (F.array(*[F.lit(float(x)) for x in values]) for values in model)
    places = F.filter(F.transform(F.split(token, ""), lambda c: F.when(c != "", F.instr(F.lit(SIGNS), c))), lambda i: i.isNotNull())
    start = F.struct(F.lit(START).alias("last"), F.lit(0.0).alias("cost"))

    def add(state: Column, i: Column) -> Column:
        sort = F.element_at(sorts, i)
        turn = F.element_at(turns, state["last"] * len(SORTS) + sort + 1)
        return F.struct(sort.alias("last"), (state["cost"] + turn + F.element_at(costs, i)).alias("cost"))

    return F.aggregate(places, start, add)["cost"]


def _joint(x: Column) -> Column:
    v, n, k = x["v"], x["n"], x["k"]
    count = lambda b: F.size(F.filter(v, lambda s: F.floor(s * 8 / k) == b))
    width = lambda b: F.ceil((b + 1) * k / 8) - F.ceil(b * k / 8)  # noqa: E731  symbols of the alphabet in a range
    chi = F.lit(0.0)
    for b in range(8):
        expected = n * width(b) / k
        chi = chi + (count(b) - expected) * (count(b) - expected) / expected
    cube = (F.pow(chi / 7, F.lit(1 / 3)) - (1 - 2 / 63)) / (2 / 63) ** 0.5
    after = F.slice(v, 2, F.size(v))
    pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    add = lambda a, b: a + b
    mean = F.aggregate(v, F.lit(0.0), add) / n
    return _let(
        F.struct(
            x["name"].alias("name"), x["odds"].alias("odds"), n.alias("n"), cube.alias("cube"), mean.alias("mean"), v.alias("v"), pairs.alias("pairs"),
            F.size(F.filter(v, lambda s: s >= k / 2)).cast("double").alias("high"),
            F.size(F.filter(pairs, lambda p: (p["a"] >= k / 2) != (p["b"] >= k / 2))).cast("double").alias("turns"),
        ),
        _p_values,
    )


def _p_values(x: Column) -> Column:
    n, high = x["n"], x["high"]
    expected = 2 * high * (n - high) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs = F.when(spread > 0, F.abs(x["turns"] + 1 - expected) / F.sqrt(spread)).otherwise(8.0)
    around = lambda a, b: (a - x["mean"]) * (b - x["mean"])
    square = F.aggregate(x["v"], F.lit(0.0), lambda s, a: s + around(a, a))
    cross = F.aggregate(x["pairs"], F.lit(0.0), lambda s, p: s + around(p["a"], p["b"]))
    serial = F.when(square > 0, F.abs(cross / square + 1 / n) * F.sqrt(n)).otherwise(8.0)
    least = F.least(
        normal_above(x["cube"]), F.least(F.lit(1.0), 2 * normal_above(runs)), F.least(F.lit(1.0), 2 * normal_above(serial))
    )
    joint = F.least(F.lit(1.0), 3 * floor_p(least))
    return F.struct(
        x["name"].alias("name"), F.floor(F.log2(n)).cast("int").alias("long"), (-F.log(joint)).alias("apart"),
        F.greatest(x["odds"], F.lit(0.0)).alias("weight"),
    )


def thresholds(tests: DataFrame, weight: str = "weight", false_share: float = FALSE_SHARE) -> DataFrame:
    """One row: {encoding/length class: least -log p that the Benjamini-Hochberg rule takes}.

    ``tests`` has name, long, -log p (column ``weight``) and the token's key per candidate; repeats of a
    token are one test.  They are counted into cells of weight first, so what follows has up
    to ``CELLS`` rows per encoding and length class.
    """
    tests = tests.select("name", "long", weight, "key").distinct()
    cell = F.least(F.floor(weight), F.lit(CELLS - 1)).cast("int")
    counted = tests.groupBy("name", "long", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    lists = counted.groupBy("name", "long").agg(
        F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("of"), F.sum("n").alias("all")
    )
    above = lambda c: F.aggregate(
        F.sequence(c, F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(F.element_at("of", i), F.lit(0))
    )
    # under the tested hypothesis no token has a weight of c with a chance above exp(-c)
    good = F.filter(F.sequence(F.lit(1), F.lit(CELLS - 1)), lambda c: F.col("all") * F.exp(-c) <= false_share * above(c))
    lists = lists.select(F.concat_ws("/", "name", "long").alias("key"), F.array_min(good).alias("from"))
    return lists.agg(F.map_from_entries(F.collect_list(F.struct("key", "from"))).alias("from"))


def _taken(test, weight: Column, limits: Column) -> Column:
    """Whether a -log p reaches its class's threshold."""
    return F.coalesce(weight >= F.element_at(limits, F.concat_ws("/", test["name"], test["long"])), F.lit(False))


def _tagged(spans: Column, kind: int) -> Column:
    """Spans of one kind in the order in which they are sorted and printed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """Per document the counts of known forms, a digest of their spans, and all spans as text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = with_places(rows, "assign", ASSIGN, keep_groups=2)
    rows = with_places(rows, "access", ACCESS)
    rows = with_places(rows, "hex", HEX)
    rows = with_places(rows, "candidate", CANDIDATE)
    rows = rows.drop("text").withColumn("assign", F.filter("assign", lambda s: F.length(s["text"]) >= 6))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[_tagged(F.col(kind), k) for k, kind in enumerate(KINDS[:3])])))
    apart = F.filter(
        "candidate", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    )
    model = fitted(docs.select(whole_text().alias("text")))
    tested = F.transform(
        apart, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), battery(c["text"], model).alias("test"))
    )
    small = written(
        rows.select("doc_id", *[F.size(k).alias(f"n_{k}") for k in KINDS[:3]], "base", tested.alias("tested")), "spans"
    )
    tests = small.select(F.explode("tested").alias("t")).select("t.test.*")
    ruled_out = thresholds(tests, "apart", DROPPED_SHARE)
    # tokens ruled out stay tests of the second rule, as ones that say nothing
    uniform = lambda t, out: F.when(_taken(t, t["apart"], out), 0.0).otherwise(t["weight"])
    each = {c: F.col(c) for c in ("name", "long", "apart", "weight", "key")}
    weighed = tests.withColumn("out", ruled_out.scalar()).withColumn("weight", uniform(each, F.col("out"))).drop("out")
    small = small.withColumn("out", ruled_out.scalar()).withColumn("from", thresholds(weighed).scalar())
    random = F.filter("tested", lambda c: _taken(c["test"], uniform(c["test"], F.col("out")), F.col("from")))
    names = F.array(*[F.lit(k) for k in KINDS])
    printed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
    return small.select(
        "doc_id",
        *[F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(printed(F.col("base")), 256).alias("base_sha256"),
        printed(F.array_sort(F.concat("base", _tagged(random, 3)))).alias("spans"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
