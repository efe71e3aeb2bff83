import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
     T.StructField("row", T.StringType()), T.StructField("key", T.IntegerType()), T.StructField("range", T.IntegerType())]
)


def words(n, seed, letters="abcdefghijklmnop"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


def edge_texts():
    long = "\n".join(words(30, 1000 + i) for i in range(700))
    return [
        None, "", " ", "\n", "\n\n", "a", "ab cd", "é" * 50, "🙂" * 40 + " x", "x" * 3000, " " * 2500 + "y", long, long, long + " z",
        words(300, 1), words(300, 1), words(300, 1) + " one more", words(60, 2), "\t\x0b\x0c\r\n", "0\x00 1", words(80, 3) + "\n" + words(80, 3),
        'password = "abcdef123" Secret:short TOKEN=abc', "AKIA" + "A" * 16 + " AKIAAKIA12 " + "ab" * 20 + "g", "Ünïcode ÄÖ ß " + words(20, 4),
    ]


def edge_rows():
    rows = []
    for i, text in enumerate(edge_texts()):
        lang, source = [("en", "b"), ("fr", "a"), (None, None)][i % 3]
        rows.append((i * 3, text, lang, source, None if text is None else len(text), "s", "r", i, None))
    rows += [rows[14], rows[14], (None, words(50, 9), "en", "b", 1, None, None, None, 1), (None,) * 9]
    return rows


def collected(df):
    return [tuple(r) for r in df.collect()]


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
