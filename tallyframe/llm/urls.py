"""URL filter: a blocked Bloom filter of listed URLs, then an exact hash join of what passes it.

Two kinds of entries are listed under one key each:

* **rules** (host, path, verdict): a rule fits its host and all subdomains of it, if the URL's
  path starts with the rule's path.  The rule with the longest text (host and path joined)
  wins, of equal ones that with the longer host;
* **listed URLs**, in canonical form, which are blocked if no rule fits.

The filter has blocks of 512 bits.  A key's hash picks its block, a second hash one bit in
each of the block's eight words, so a key is tested by one look at one block.  The filter is
built by an aggregate (``bit_or`` per block) and broadcast: it has at most ``MOST_BLOCKS``
blocks, whatever the list's size, and 12 bits a key up to then.  With more keys than that, more
URLs pass without being listed and the exact join has more to do; results stay the same.

Each different URL is tested once for its canonical form and once for each shape (number of
host labels, length of path) that rules have; what passes is joined with the list by the key
itself, distinct keys first, so a key that very many URLs share meets the list once.

Canonical form: host in lower case (A-Z) without user, port and a leading ``www.`` or ``m.``, and path
without a final slash; scheme, query and fragment go.

Built-in functions only.  Defined cases: a null URL or one without ``://`` has an empty host
and path, fits no rule and is not listed; empty tables of pages give no rows, empty lists
allow all; null and repeated list entries count once; a rule listed with both verdicts blocks;
repeated and null page ids are kept row by row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.tables import read, written

BITS_A_KEY, BLOCK_BITS, WORDS, MOST_BLOCKS, MOST_SHAPES = 12, 512, 8, 1 << 20, 4096
RULE_SCHEMA = "host string, path string, verdict string"
#: The rules of the query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Words of host names, between dots and hyphens, of sites whose URLs the query lists.
SITE_WORDS = [
    "adult", "porn", "xxx", "sex", "casino", "poker", "bet", "bets", "betting", "lotto", "pills", "pharma", "viagra", "spam", "malware",
    "phishing", "warez", "ads", "adserver", "tracker",
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The canonical form of a URL, null for an empty host."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"(?s):[0-9]*$", ""), r"(?s)^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(?s)/+\z", "")))


def _rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("rule "), host, F.lit(" "), path)


def _url_key(url: Column) -> Column:
    return F.concat(F.lit("url "), url)


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """The list: key, rule (its text; null for listed URLs), verdict, host length and shape (labels, long)."""
    host, path = ascii_lower(F.col("host")), F.col("path")
    kept = rules.select("host", "path", "verdict").dropna()
    prefixes = kept.groupBy(_rule_key(host, path).alias("key")).agg(
        F.concat(F.first(host), F.first(path)).alias("rule"),
        F.max("verdict").alias("verdict"),  # block is after allow
        F.length(F.first(host)).alias("host_long"),
        F.size(F.split(F.first(host), r"\.")).alias("labels"),
        F.length(F.first(path)).alias("long"),
    )
    urls = listed.select(_url_key(F.col("url")).alias("key")).dropna().distinct()
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("host_long", "int"), ("labels", "int"), ("long", "int"))]
    return prefixes.unionByName(urls.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), *none))


def _masks(key: Column) -> list[Column]:
    """The bit of each word of a key's block."""
    spread = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(spread, 6 * w).bitwiseAND(63).cast("int")) for w in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(keys: DataFrame, n: int, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, int]:
    """The filter's blocks that hold a bit (block, w0 ...) for ``n`` keys (key), and how many blocks it has."""
    blocks = max(1, min(most_blocks, -(-n * BITS_A_KEY // BLOCK_BITS)))
    bits = [F.bit_or(m).alias(f"w{w}") for w, m in enumerate(_masks(F.col("key")))]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*bits), blocks


def passing(tested: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``tested`` (with key) that the filter lets through: all listed ones and few others."""
    found = tested.join(F.broadcast(filter_), _block(F.col("key"), blocks) == F.col("block"))
    hit = F.lit(True)
    for w, mask in enumerate(_masks(F.col("key"))):
        hit = hit & (F.col(f"w{w}").bitwiseAND(mask) != 0)
    return found.filter(hit).select(*tested.columns)


def judged(pages: DataFrame, rules: DataFrame, listed: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    ``rules`` has host, path and verdict (allow or block), ``listed`` canonical URLs (url).
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"))
    list_ = written(entries(rules, listed), "url-list")
    shapes = list_.filter("labels is not null").select("labels", "long").distinct().limit(MOST_SHAPES + 1).collect()  # bounded by the rules' shapes
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"rules of more than {MOST_SHAPES} shapes (host labels, length of path)")
    filter_, blocks = bloom(list_.select("key"), list_.count(), most_blocks)
    host, path = F.col("host"), F.col("path")
    urls = pages.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    suits = lambda s: (F.size(F.split(host, r"\.")) >= s["labels"]) & (F.length(path) >= s["long"])
    prefix = lambda s: _rule_key(F.substring_index(host, ".", -s["labels"]), F.substring(path, 1, s["long"]))
    keys = F.array(_url_key(canonical(host, path)), *[F.when(suits(s), prefix(s)) for s in shapes])
    tested = urls.select("url", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
    hits = written(passing(tested, filter_, blocks), "url-hits")
    # the exact join: each different key meets the list once
    sure = hits.select("key").distinct().join(list_, "key").select("key", "rule", "verdict", "host_long")
    sure = hits.join(sure, "key")
    strongest = F.struct(F.col("rule").isNotNull(), F.length("rule"), "host_long")
    verdicts = sure.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), strongest).alias("found"))
    verdicts = verdicts.withColumnRenamed("url", "of")
    return pages.join(verdicts, pages["url"] == verdicts["of"], "left").select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit("allow")).alias("verdict"),
    )


def urls_of_sites(pages: DataFrame, site_words: list[str] = SITE_WORDS) -> DataFrame:
    """The canonical URLs (url) of pages of sites with one of ``site_words`` between the dots and hyphens of the host."""
    host = host_of(F.col("url"))
    unwanted = F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*[F.lit(w) for w in site_words]))
    return pages.filter(unwanted).select(canonical(host, path_of(F.col("url"))).alias("url")).distinct()


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, spark.createDataFrame(RULES, RULE_SCHEMA), urls_of_sites(pages))


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_SITES = ", ".join(f"'{w}'" for w in SITE_WORDS)
OP12_SQL = rf"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
parts AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
found AS (
  SELECT r, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM parts, rules WHERE starts_with(path, rule_path) AND (host = rule_host OR ends_with(host, '.' || rule_host))),
listed AS (
  SELECT DISTINCT host, rtrim(path, '/') AS path FROM parts WHERE list_has_any(regexp_split_to_array(host, '[.\-]'), [{_SITES}]))
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN found.verdict WHEN EXISTS (
    SELECT 1 FROM listed AS l
    WHERE regexp_replace(l.host, '^(www|m)\.', '') = regexp_replace(parts.host, '^(www|m)\.', '') AND l.path = rtrim(parts.path, '/')
  ) THEN 'block' ELSE 'allow' END AS verdict
FROM parts LEFT JOIN found USING (r) WHERE place IS NULL OR place = 1
"""
