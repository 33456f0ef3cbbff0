"""WARC derivatives: for each response a metadata record and a plain-text conversion record.

Both refer to the response by WARC-Refers-To and share its target and date. The metadata block is JSON with
the source's HTTP headers and digests, title and links; the conversion block is the page's visible text, a
line for each block. Record ids are derived from the response's id, target, date and payload, so that rebuilding gives the
same files, and two captures of one address have records of their own.

Null uris, dates, headers and bodies count as empty; such responses still get both records. Rows that repeat repeat
theirs. Extra columns are ignored. A row's two records are made in one task, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import parse

VERSION, CRLF = "WARC/1.1", "\r\n"
RECORD = (
    "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, "
    "source_payload_digest string, block_digest string, content_length long, block string"
)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_LINK = re.compile(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def urn(*parts: str) -> str:
    h = hashlib.md5("\0".join(parts).encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def split_headers(headers: str) -> tuple[str, list[list[str]]]:
    """(status line, pairs in their order); a name may repeat."""
    first, *rest = re.split(r"\r?\n", headers.strip()) if headers.strip() else [""]
    return first, [[k.strip(), v.strip()] for k, _, v in (x.partition(":") for x in rest) if k.strip()]


def derive(record_id: str, uri: str, date: str, headers: str, body: str) -> list[tuple]:
    raw = body.encode("utf-8", "surrogatepass")
    payload, block = digest(raw), digest(f"{headers}{CRLF}{CRLF}".encode("utf-8", "surrogatepass") + raw)
    status, pairs = split_headers(headers)
    title = _TITLE.search(body)
    about = {
        "status": status,
        "headers": pairs,
        "payload_digest": payload,
        "block_digest": block,
        "payload_length": len(raw),
        "title": " ".join(html.unescape(title[1]).split()) if title else "",
        "links": [html.unescape(a or b or c) for a, b, c in _LINK.findall(body)],
    }
    text = "\n".join(t for _, t in parse(body)[1])
    out = []
    for kind, content_type, content in (("metadata", "application/json", json.dumps(about, ensure_ascii=False)), ("conversion", "text/plain", text)):
        data = content.encode("utf-8", "surrogatepass")
        out.append((urn(kind, record_id, uri, date, payload), kind, record_id, uri, date, content_type, payload, digest(data), len(data), content))
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """(id, RECORD) of responses (id, record_id, target_uri, warc_date, http_headers, body): two rows for each."""
    columns = ("record_id", "target_uri", "warc_date", "http_headers", "body")
    rows = responses.select("id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))
    kinds = [pa.string()] * 8 + [pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                made = [r for x in zip(*(b.column(c).to_pylist() for c in columns), strict=True) for r in derive(*x)]
                ids = b.column("id").take(pa.array([i // 2 for i in range(len(made))], pa.int64()))
                yield pa.record_batch([ids, *(pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], ["id", *names])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {RECORD}")


def responses_of_pages(pages: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages as responses; ids from the page's id, url, date and content. Rows equal in all of these are one capture."""
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    h = F.md5(F.concat_ws("|", text("page_id"), text("url"), F.lit(date), F.md5(text("html"))))
    part = lambda a, n: F.substring(h, a, n)
    return pages.select(
        F.col("page_id").alias("id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length).alias("http_headers"),
        F.col("html").alias("body"),
    )


def write_warc(records: DataFrame, path: str, most: int = 10_000) -> None:
    """WARC files of at most `most` records, by Spark's own text writer: its line feed ends the record."""
    line = lambda name, column: F.concat(F.lit(f"{CRLF}{name}: "), column)
    record = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.col("warc_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("warc_date")),
        line("WARC-Source-Payload-Digest", F.col("source_payload_digest")),  # an extension, which readers skip
        line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
        F.lit(CRLF * 2),
        F.col("block"),
        F.lit("\r\n\r"),
    )
    records.select(record.alias("value")).write.option("maxRecordsPerFile", most).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record, by content lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split(CRLF)[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(fields map, block) of the records of all files under `path`; a file is read by one task, as any WARC is.

    A file of over 2 GB is no value of a column: `write_warc` bounds its files by a number of records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                for fields, block in parse_warc(content.as_buffer().to_pybytes()):
                    yield pa.record_batch([pa.array([list(fields.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], ["fields", "block"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "fields map<string,string>, block binary")
