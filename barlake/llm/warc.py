"""WARC archives: written through Spark's text writer, read back by verifying the chain of record boundaries.

A payload may hold the record magic, so its occurrences are only candidates.  Tasks emit each candidate's offset and
that of its successor (from its lengths); pointer jumping from the start of each file keeps what is reachable.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import let
from barlake.session import staged

MAGIC = b"WARC/1.0\r\n"
CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 5000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: every five hex digits are four letters."""
    return let(let(F.sha1(payload), _bits), _letters)


def _bits(hex_digits: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.conv(F.substring(hex_digits, i * 5 + 1, F.lit(5)), 16, 2), 20, "0")), "")


def _letters(bits: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.lit(BASE32), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))), "")


def _one_line(value: Column) -> Column:
    """A header value: line breaks would end it, so they are percent-encoded."""
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write one record per row to files under ``path``; the payload is the text in UTF-8 (null: empty).

    Of rows with equal payloads the one with the largest key is written whole (response), the others refer to it
    (revisit).  Rows with a null key have an empty id and are whole, as nothing can refer to them; repeated keys
    with equal payloads are all responses.  The payload moves once, to meet its digest's winner; only digests that
    occur more than once are joined.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("body"), base32_sha1(body).alias("digest"))
    winners = staged(rows.groupBy("digest").agg(F.max("key").alias("winner"), F.count("*").alias("n")).where("n > 1").select("digest", "winner"))
    head = lambda kind, block, *more: F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: " + kind + "\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), _one_line(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), *more, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    )
    status = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    whole = head("response", F.concat(status, F.col("body")))
    refer = head("revisit", status, F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("winner").cast("string"), F.lit(">"))
    record = F.when(F.col("winner") > F.col("key"), refer).otherwise(whole)
    rows.join(winners, "digest", "left").select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).mode("errorifexists").text(path)


FIELDS = "path string, start long, next long, record_id string, record_type string, url string, refers_to string, digest string, payload_bytes long, payload_digest string, payload binary"


def _field(lines: list[bytes], name: bytes) -> str | None:
    for line in lines:
        if line[: len(name) + 1].lower() == name + b":":
            return line[len(name) + 1 :].strip().decode("utf-8", "replace")
    return None


def _candidate(whole: bytes, start: int) -> tuple | None:
    """Read a record at ``start`` if its header is complete and its block ends in two line breaks."""
    stop = whole.find(b"\r\n\r\n", start)
    if stop < 0:
        return None
    lines = whole[start:stop].split(b"\r\n")[1:]
    length = _field(lines, b"content-length") or ""
    if not (length.isascii() and length.isdigit()):
        return None
    begin, end = stop + 4, stop + 4 + int(length)
    if whole[end : end + 4] != b"\r\n\r\n":
        return None
    kind = _field(lines, b"warc-type")
    split = whole.find(b"\r\n\r\n", begin, end)
    payload = whole[split + 4 : end] if split >= 0 and kind in ("response", "revisit") else whole[begin:end]
    named = _field(lines, b"warc-payload-digest")
    return end + 4, _field(lines, b"warc-record-id"), kind, _field(lines, b"warc-target-uri"), _field(lines, b"warc-refers-to"), named, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload


def _candidates(source: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            name, whole, rows, size = path.as_py(), content.as_py(), [], 0
            at = whole.find(MAGIC)
            while at >= 0:
                if (found := _candidate(whole, at)) is not None:
                    rows.append((name, at, *found))
                    size += found[6]
                at = whole.find(MAGIC, at + 1)
                if rows and (size > 4 << 20 or at < 0):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives under ``path``: those that the chain from each file's start reaches.

    Columns as FIELDS, without the payloads themselves if ``payload`` is false; ``payload_digest`` is computed from the payload read, ``digest`` is what the header says.  What
    follows a break in a file's chain is not returned.  An empty folder gives no rows.  Files are read whole by one
    task each, so archives should be rotated, as ``write_warc`` does; candidates are stored once in the shared folder.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("next", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    found = files.mapInArrow(lambda source: _candidates(source, schema), FIELDS)
    found = staged(found if payload else found.drop("payload"))
    return found.join(reachable(found.select("path", "start", "next")), ["path", "start"], "left_semi")


def reachable(links: DataFrame) -> DataFrame:
    """(path, start) of the links that the chain from offset 0 of each path reaches, by pointer jumping.

    Each round doubles the length of the jumps, so the rounds are logarithmic in the longest chain; a round's tables
    are written to the shared folder.
    """
    jumps, seen = links, staged(links.where("start = 0").select("path", "start").distinct())
    count = seen.count()
    while count:
        step = jumps.select("path", "start", F.col("next").alias("to"))
        landed = seen.join(step, ["path", "start"]).select("path", F.col("to").alias("start"))
        seen = staged(seen.union(landed.join(links.select("path", "start"), ["path", "start"], "left_semi")).distinct())
        last, count = count, seen.count()
        if count == last:
            break
        jumps = staged(jumps.select("path", "start", F.col("next").alias("via")).join(jumps.select("path", F.col("start").alias("via"), "next"), ["path", "via"]).select("path", "start", "next"))
    return seen
