"""WARC archives: writing captures as request, response and metadata records, and assembling them again.

A capture is three records that carry one identifier: the response (or revisit) record owns it as
WARC-Record-ID, the request and metadata records name it as WARC-Concurrent-To. Archives are plain
WARC 1.1 under gzip: Spark's text writer ends each record with two line breaks, as the format asks.

Defined cases: a null or empty page is a payload of 0 bytes; a null url or page_id stays null;
rows equal in payload and page_id are all responses if that page_id is the largest, and revisits
that refer to it if not; pages without a page_id revisit one that has one; an empty table writes an
archive without records, which reads as no captures. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.llm.common import query, salted_join, stored, table
from stockloom.session import run_dir

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_type string, record_id string, concurrent_to string, target_uri string, payload_digest string, "
    "payload_bytes long, refers_to_uri string, fields string, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_roles(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """Pages with ``first_id``: the page whose response holds the same payload, null for a response.

    Payloads are told apart by SHA-1, SHA-256 and length. Only payloads that repeat are kept for the join.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.concat(F.sha1("html"), F.sha2("html", 256), F.octet_length("html").cast("string")))
    repeats = (
        keyed.filter(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first_id"), F.max_by("url", "page_id").alias("first_url"))
        .filter("n > 1")
    )
    joined = salted_join(keyed, stored(repeats, "payloads"), ["digest"], "n", ["page_id"], "left")
    refers = ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    return joined.select(
        "page_id", "url", "html",
        F.when(refers, F.col("first_id")).alias("first_id"), F.when(refers, F.col("first_url")).alias("first_url"),
    )


def record(headers: list[tuple[str, str | None]], kind: str, block: str) -> str:
    """One record without the two line breaks that end it."""
    lines = [f"{name}: {value}" for name, value in headers if value is not None]
    size = len(block.encode("utf-8"))
    return "\r\n".join([VERSION, *lines, f"Content-Type: {kind}", f"Content-Length: {size}", "", block])


def uri(url: str | None) -> str | None:
    """A url fit for a header line."""
    return None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url if ord(c) < 128 or c.isprintable())


def capture_records(page_id: int | None, url: str | None, html: str, first_id: int | None, first_url: str | None, date: str) -> list[str]:
    body = html.encode("utf-8")
    own, at = f"<urn:uuid:{uuid.uuid4()}>", uri(url)
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    digest = base32_sha1(body)
    common = [("WARC-Target-URI", at), ("WARC-Date", date)]
    hub = [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first_id is None:
        main = record([("WARC-Type", "response"), *hub], "application/http;msgtype=response", answer + html)
    else:
        hub += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Target-URI", uri(first_url)), ("WARC-Refers-To-Date", date)]
        main = record([("WARC-Type", "revisit"), *hub], "application/http;msgtype=response", answer)
    side = lambda kind: [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common, ("WARC-Concurrent-To", own)]
    facts = json.dumps({"page_id": page_id, "url": url, "payload_bytes": len(body), "refers_to": first_id})
    host = (at or "").partition("://")[2].partition("/")[0]
    request = record(side("request"), "application/http;msgtype=request", f"GET {at or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n")
    return [request, main, record(side("metadata"), "application/warc-fields", f"capture: {facts}\r\n")]


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 3000) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files to ``path``.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest
    page_id becomes a response, the others revisit it. ``records_per_file`` bounds a file, which a
    reader holds as a whole, compressed.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x)
        text = lambda x: None if pd.isna(x) else x
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.iloc[lo : lo + 200]
                out = []
                for row in part.itertuples(index=False):
                    out += capture_records(whole(row.page_id), text(row.url), row.html, whole(row.first_id), text(row.first_url), date)
                yield pd.DataFrame({"value": out})

    roles = with_roles(pages, min_revisit_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "first_id")})
    out = roles.mapInPandas(records, "value string")
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class Unzipped:
    """Reads of a gzip file in memory, a piece at a time."""

    def __init__(self, data: bytes, piece: int = 1 << 20):
        self.data, self.at, self.piece = memoryview(data), 0, piece
        self.inflate, self.buffer = zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        given = self.data[self.at : self.at + self.piece]
        self.at += len(given)
        self.buffer += self.inflate.decompress(given)
        while self.inflate.eof and self.inflate.unused_data:  # members one after another
            rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            self.buffer += self.inflate.decompress(rest)
        return True

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size and self.more():
            pass
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which goes; None at the end of the file."""
        start = 0
        while (found := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        out = bytes(self.buffer[:found])
        del self.buffer[: found + len(mark)]
        return out


def parse(data: bytes, keep_payload: bool) -> Iterator[tuple]:
    """Rows of RECORD, framed by Content-Length alone, so that payloads may hold anything."""
    source = Unzipped(data)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").split("\r\n")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = source.take(int(headers["content-length"]))
        source.take(4)
        kind, payload, size = headers["warc-type"], None, None
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size, digest = len(payload), base32_sha1(payload)
        fields = block.decode("utf-8").partition("capture: ")[2].strip() if kind == "metadata" else None
        yield (
            kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), digest, size,
            headers.get("warc-refers-to-target-uri"), fields, payload if keep_payload else None,
        )


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """All records of the archives under ``path``, one row each."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out, held = [], 0
                for row in parse(content, keep_payload):
                    out.append(row)
                    held += len(row[-1] or b"")
                    if len(out) >= 2000 or held > 1 << 24:
                        yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(rows, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata, null where missing.

    The records meet on the identifier that they are concurrent to, in one shuffle.
    """
    part = lambda *kinds: F.first(F.when(F.col("record_type").isin(*kinds), F.struct(*(c for c in records.columns))), ignorenulls=True)
    return (
        records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
        .groupBy("capture_id")
        .agg(part("response", "revisit").alias("response"), part("request").alias("request"), part("metadata").alias("metadata"))
    )


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM b
"""


@query("op5_warc", SQL)
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Write every page to an archive, read it back and assemble the captures."""
    path = run_dir(spark, "warc")
    write_archive(table(spark, folder, "pages"), path, min_revisit_bytes=0)
    facts = F.from_json("metadata.fields", "page_id long, url string, payload_bytes long, refers_to long")
    return captures(read_records(spark, path, keep_payload=False)).withColumn("facts", facts).select(
        F.col("facts.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "facts.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("facts.refers_to").alias("refers_to"),
    )
