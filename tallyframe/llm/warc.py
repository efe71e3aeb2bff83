"""WARC archives: writing pages, and a reader that salvages damaged files.

A page whose payload other pages share is written once, as the ``response`` with the
largest page id; the others are ``revisit`` records that refer to it.  Spark's text writer
makes the archives: a record ends in two line ends, which is the writer's separator, so
files are valid WARC and come from the usual committed output of tasks.

The reader checks version line, header, length, closing line ends, block and payload
digests, and for compressed archives each member's own checksum.  After a failed check it
searches the next version line (or member) whose record passes all checks, goes on there,
and logs the bytes in between as a quarantined gap with the reason.  A damaged record's own
length is not trusted; only that of a member whose checksum is right is.  An archive is read as one row, so the writer bounds the
records per file.

Defined cases: a null page is an empty payload and has null ids kept as such; empty
payloads are equal to each other; rows that repeat the largest id of a payload are all
responses; a null id is smaller than any other; urls are percent-coded; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.tables import in_batches, read, rows_of, written
from tallyframe.session import new_path

END, HEAD = b"\r\n\r\n", b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
#: Records of a file, and the bytes of a page in the first class; so a file has some 128 MB, or one larger page.
FILE_RECORDS, SMALL_PAGE, LEAST_REVISIT = 2000, 1 << 16, 0
ONCE = {"warc-type", "warc-record-id", "warc-date", "content-length"}  # twice in a header: two records have run together
ID = "urn:x-page:"
DATE = "2000-01-01T00:00:00Z"
FIELDS = (
    "kind string, archive string, start long, length long, reason string, page_id long, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)
SCHEMA = pa.schema(
    [("kind", pa.string()), ("archive", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("reason", pa.string()),
     ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def uri(page_id: int | None) -> str:
    return f"<{ID}{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record without the two line ends that close it."""
    kind = "revisit" if revisit else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += [f"WARC-Refers-To: {uri(refers_to)}", f"WARC-Refers-To-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block


class Damaged(Exception):
    """A failed check; ``end`` is known if the extent is sound all the same."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


def parse(data: bytes, at: int) -> tuple[int, dict]:
    """The record that starts at ``at`` and the place after it; raises Damaged."""
    if data[at : at + len(HEAD)] != HEAD:
        raise Damaged("no version line")
    following = data.find(b"\n" + HEAD, at)
    close = data.find(END, at, following + 1 if following >= 0 else len(data))
    if close < 0:
        raise Damaged("header without end")
    lines = data[at:close].decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Damaged("header line without a name")
        name = name.strip().lower()
        if (HEAD.decode() in value and name != "warc-target-uri") or (name in ONCE and name in fields):
            raise Damaged("header runs into another record")
        fields.setdefault(name, value.strip())
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 19):
        raise Damaged("no length")
    begin = close + len(END)
    end = begin + int(length)
    if data[end : end + len(END)] != END:
        raise Damaged("record does not end where its length says")
    block, end = data[begin:end], end + len(END)
    if "warc-type" not in fields or "warc-record-id" not in fields:
        raise Damaged("field missing")
    want = fields.get("warc-block-digest")
    if want and want != f"sha1:{digest(block)}":
        raise Damaged("block digest differs")
    split = block.find(END) if fields.get("content-type", "").startswith("application/http") else -len(END)
    payload = block[split + len(END) :] if split != -1 else b""
    full = fields["warc-type"] != "revisit"
    want = fields.get("warc-payload-digest")
    if full and want and want != f"sha1:{digest(payload)}":
        raise Damaged("payload digest differs")
    return end, {
        "page_id": page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "payload_bytes": len(payload) if full else whole(fields.get("warc-refers-to-payload-length")),
        "payload_digest": (want or f"sha1:{digest(payload)}").removeprefix("sha1:"),
        "refers_to": page_of(fields.get("warc-refers-to", "")),
        "payload": payload if full else None,
    }


def whole(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.removeprefix("-").isdigit() else None


def page_of(value: str) -> int | None:
    return whole(value.strip("<>").removeprefix(ID))


def parse_member(data: bytes, at: int) -> tuple[int, dict]:
    """The record in the compressed member that starts at ``at``, and the place after it."""
    inflate, parts, view = zlib.decompressobj(31), [], memoryview(data)
    place = at
    try:
        while not inflate.eof and place < len(data):
            parts.append(inflate.decompress(view[place : place + (1 << 16)]))
            place += 1 << 16
    except zlib.error as error:
        raise Damaged(f"member: {error}") from None
    if not inflate.eof:
        raise Damaged("member without end")
    end = min(place, len(data)) - len(inflate.unused_data)
    inner = b"".join(parts)
    try:
        used, found = parse(inner, 0)
    except Damaged as error:
        raise Damaged(error.reason, end) from None
    if used != len(inner):
        raise Damaged("member holds more than a record", end)
    return end, found


def salvaged(data: bytes) -> Iterator[tuple]:
    """("record", start, length, None, fields) and ("gap", start, length, reason, {}) over all bytes of an archive."""
    zipped = data[:2] == MEMBER[:2] or (HEAD not in data and MEMBER in data)
    read_one, mark = (parse_member, MEMBER) if zipped else (parse, HEAD)
    at, gap, reason = 0, None, None
    while at < len(data):
        try:
            end, fields = read_one(data, at)
        except Damaged as error:
            if gap is None:
                gap, reason = at, error.reason
            after = error.end if error.end else data.find(mark, at + 1)
            at = after if after >= 0 else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, reason, {}
            gap = None
        yield "record", at, end - at, None, fields
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, reason, {}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives in a folder: ``kind`` tells which, gaps have place, length and reason."""

    def work(batches):
        def rows():
            for path, data in rows_of(batches, "path", "content"):
                for kind, start, length, reason, f in salvaged(data):
                    yield (
                        kind, path, start, length, reason, *[f.get(n) for n in SCHEMA.names[5:11]], f.get("payload") if payloads else None
                    )

        yield from in_batches(rows(), SCHEMA)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, FIELDS)


def write_archives(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, file_records: int = FILE_RECORDS) -> None:
    """Write pages (page_id, url, html) as archives into a folder.

    Only payloads of at least ``least_revisit`` bytes that more than one page has can
    become revisits; the table of those is joined to the pages, others stay as they are.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"), F.sha2(html, 256).alias("sum"),
        F.octet_length(html).alias("long"),
    )
    shared = rows.filter(F.col("long") >= least_revisit).groupBy(F.col("sum").alias("of"))
    shared = shared.agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = rows.join(written(shared, "warc-shared"), F.col("sum") == F.col("of"), "left")
    revisit = F.col("of").isNotNull() & F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())

    def work(batches):
        schema = pa.schema([("value", pa.string())])

        def made():
            for page, url, text, first, again in rows_of(batches, "page_id", "url", "html", "first", "again"):
                yield (record(page, url, text.encode(), first, again).decode(),)

        yield from in_batches(made(), schema)

    # a percent-coded url has up to three bytes for one
    room = F.greatest(F.col("long") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)), F.lit(1))
    sized = joined.select("page_id", "url", "html", "first", revisit.alias("again"), _size_class(room).alias("class"))
    classes = [r["class"] for r in rows.select(_size_class(room).alias("class")).distinct().collect()]  # at most 16
    for class_ in sorted(classes) or [0]:
        out = sized.filter(F.col("class") == class_).drop("class").mapInArrow(work, "value string")
        out.write.mode("append").option("lineSep", END.decode()).option("maxRecordsPerFile", max(1, file_records >> class_)).text(path)


def _size_class(room) -> Column:
    """0 up to ``SMALL_PAGE`` bytes, 1 up to twice as many, and so on."""
    return F.greatest(F.ceil(F.log2(room / SMALL_PAGE)), F.lit(0)).cast("int")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "llm-warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, payloads=False)
    # a gap in archives that were just written is lost pages
    gap = F.concat(F.lit("gap in a written archive: "), F.concat_ws(" ", "archive", "start", "length", "reason"))
    found = found.filter(F.when(F.col("kind") == "record", True).otherwise(F.raise_error(gap).cast("boolean")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT r, page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS first FROM p),
g AS (
  SELECT *, list_transform(range(8), lambda k: ('0x' || substr(hex, 5 * k + 1, 5))::BIGINT) AS parts FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""
