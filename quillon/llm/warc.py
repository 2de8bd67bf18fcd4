"""WARC archives with revisit records.

Payload headers (digest, length, page) are grouped by payload digest; of equal payloads the record with the smallest
page_id is the response and the others revisit it. Only digests that occur more than once are joined back, as a written table, so a
payload that very many pages share is no single task's work. Archives are then written with fresh headers: the block of a response is an
HTTP message, a revisit has the HTTP headers alone and names the response it repeats, with its URI and date. Every record has a block digest, and
the archive's warcinfo record, in a file of its own, is named by all.

Records are UTF-8 text, so Spark's own text writer makes the files: a record is a row and the blank lines that end it are the line
separator. So files are compressed as a whole, and reading one record means reading its file; they hold about `FILE_BYTES` of payload.

A null html is an empty payload. Rows without a page_id count after all ids. Of rows with equal page_id and payload one is the
response. Other columns are ignored. Empty input gives archives without pages.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import maybe_broadcast, partitions, scratch, table

FILE_BYTES = 32 << 20
#: Shared payloads up to which their table is broadcast; a larger one is joined by shuffling.
BROADCAST_PAYLOADS = 200_000
INFO = "<urn:x-archive:info>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex40: Column) -> Column:
    """RFC 4648 base32 of a SHA-1 in hexadecimal: five bits at a time from ten groups of four digits."""
    letters = []
    for at in range(0, 40, 5):  # 5 hexadecimal digits are 20 bits, 4 letters
        bits = F.conv(F.substring(hex40, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def resolve(pages: DataFrame) -> DataFrame:
    """(page_id, hex, bytes, response, response_url): for each distinct page and payload, the page whose response holds the payload."""
    html = F.coalesce("html", F.lit(""))
    headers = table(pages.select("page_id", "url", F.sha1(html).alias("hex"), F.octet_length(html).cast("long").alias("bytes")), "headers")
    page = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "url")
    first = headers.groupBy("hex", "bytes").agg(F.min(page).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    first = table(first.select("hex", "bytes", F.col("first.page_id").alias("response"), F.col("first.url").alias("response_url"), F.lit(True).alias("shared")), "shared_payloads")
    own = headers.groupBy("page_id", "hex", "bytes").agg(F.min("url").alias("url")).join(maybe_broadcast(first, BROADCAST_PAYLOADS), ["hex", "bytes"], "left")
    mine = F.col("shared").isNull()
    return own.select("page_id", "hex", "bytes", F.when(mine, F.col("page_id")).otherwise(F.col("response")).alias("response"), F.when(mine, F.col("url")).otherwise(F.col("response_url")).alias("response_url"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _uri(url: Column) -> Column:
    return F.regexp_replace(url, r"[\r\n]", " ")


def _records(typed: DataFrame, date: str) -> DataFrame:
    """(value): whole records without the blank lines after them. typed: (page_id, nth, url, html, hex, bytes, type, response, response_url)."""
    id_ = lambda page, nth: F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), nth.cast("string"), F.lit(">"))
    revisit = F.col("type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    lines = [
        F.lit("WARC/1.1"),
        _line("WARC-Type", F.col("type")),
        _line("WARC-Record-ID", id_(F.col("page_id"), F.col("nth"))),
        F.lit(f"WARC-Warcinfo-ID: {INFO}"),
        F.lit(f"WARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), _line("WARC-Target-URI", _uri(F.col("url")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("hex"))),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), base32(F.sha1("block"))),
        _line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, _line("WARC-Refers-To", id_(F.col("response"), F.lit(1)))),
        F.when(revisit & F.col("response_url").isNotNull(), _line("WARC-Refers-To-Target-URI", _uri(F.col("response_url")))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        _line("Content-Length", F.octet_length("block").cast("string")),
    ]
    return typed.withColumn("block", block).select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.col("block")).alias("value"))


def write_warc(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Writes pages (page_id, url, html) as gzipped WARC files. date: of all records, the time of the run if none is given."""
    spark = pages.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    decided = table(resolve(pages), "revisits")
    total = decided.agg(F.sum("bytes")).first()[0] or 0
    files = max(partitions(spark), -(-total // FILE_BYTES))
    # payloads are shuffled once, to the tasks that write: by page and payload, so copies of one payload are spread out
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "hex")
    here = pages.withColumn("hex", F.sha1("html")).withColumn("key", key).repartition(files, "key")
    joined = here.join(decided.select(key.alias("key"), "bytes", "response", "response_url"), "key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("url"))
    typed = joined.withColumn("nth", nth).withColumn("type", F.when(F.col("page_id").eqNullSafe(F.col("response")) & (F.col("nth") == 1), "response").otherwise("revisit"))
    fields = "software: quillon\r\nformat: WARC File Format 1.1\r\n"
    info = "\r\n".join(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {INFO}", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(fields)}", "", fields])
    records = _records(typed, date).union(spark.createDataFrame([(info,)], "value string").coalesce(1))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        yield headers, stream.read(int(headers["Content-Length"]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("intact", pa.bool_())])
    page = lambda urn: None if (x := urn.split(":")[2]) == "none" else int(x)

    def sha1(data: bytes) -> str:
        return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()

    def rows(content: bytes) -> Iterator[tuple]:
        for h, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
            if h["WARC-Type"] == "warcinfo":
                continue
            revisit, body = h["WARC-Type"] == "revisit", block.partition(b"\r\n\r\n")[2]
            intact = sha1(block) == h["WARC-Block-Digest"] and (revisit or sha1(body) == h["WARC-Payload-Digest"])
            size = int(h["X-Payload-Length"]) if revisit else len(body)
            yield page(h["WARC-Record-ID"]), size, h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], page(h["WARC-Refers-To"]) if revisit else None, h.get("WARC-Target-URI"), intact

    for batch in batches:
        for content in batch.column("content"):
            out = list(rows(content.as_py()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact) of every record at path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, intact boolean")


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages and reads the archives back."""
    path = scratch(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)
