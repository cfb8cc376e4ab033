"""WARC derivatives: metadata and plain-text conversion records of response records.

Records live in a table: (record_id, type, target_uri, date, refers_to, content_type, block_digest,
payload_digest, source_headers, content_length, block). read_records() cuts WARC files into that table,
derive() adds to each response a metadata record and a conversion record that refer to it, and
serialize() makes bytes that can be appended to a file, one gzip-free record after another.

A conversion's text is the page's text without markup, scripts and styles; block elements end lines.
Metadata holds the HTTP status and headers, the payload's digest, title and links as JSON. Ids of
derived records are named from the response's id, so reruns agree. Digests are sha1 in base 32.

A response without a valid HTTP head counts as body only (status null). Null or empty pages give
records with empty blocks. Repeated rows give repeated records. A page is read once from front to back, however
long or broken: a tag that never closes is text, a comment or script that never closes is a tag. What a file
holds between records comes back as a record of type "unreadable" with the number of its bytes. An empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = [("record_id", "string"), ("type", "string"), ("target_uri", "string"), ("date", "string"), ("refers_to", "string"), ("content_type", "string"), ("block_digest", "string"), ("payload_digest", "string"), ("source_headers", "string"), ("content_length", "bigint"), ("block", "binary")]
SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS)
ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
DATE = "2024-01-01T00:00:00Z"

# Elements that are left out whole, and those that end a line.
DROPPED = ("script", "style", "noscript", "template", "head")
BREAKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav blockquote pre title body main".split())
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in DROPPED}
HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
TITLE, TITLE_END = re.compile(r"<title\b", re.I), re.compile("</title", re.I)
#: Bytes of blocks that a batch of read records holds, its last record apart.
BATCH = 1 << 24


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named(kind: str, record_id: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {record_id}')}>"


def scan(page: str) -> tuple[str, list[str]]:
    """(text, links) of a page in one pass: what has no end is looked for once and not again."""
    parts, links, at, never = [], [], 0, set()
    while (start := page.find("<", at)) >= 0:
        parts.append(page[at:start])
        if "--" not in never and page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            if end >= 0:
                parts.append(" ")
                at = end + 3
                continue
            never.add("--")
        name = (m := NAME.match(page, start)) and m[1].lower()
        if name in CLOSE and page[start + 1] != "/" and name not in never:
            end = CLOSE[name].search(page, m.end())
            if end:
                parts.append(" ")
                at = end.end()
                continue
            never.add(name)
        end = page.find(">", start + 1)
        if end < 0:
            at = start
            break
        if name in BREAKS:
            parts.append("\n")
        elif name == "a" and page[start + 1] != "/" and (href := HREF.search(page, start, end + 1)):
            links.append(html.unescape(href[1] or href[2] or href[3] or ""))
        at = end + 1
    parts.append(page[at:])
    lines = (" ".join(x.split()) for x in html.unescape("".join(parts)).split("\n"))
    return "\n".join(x for x in lines if x), links


def title_of(page: str) -> str | None:
    start = TITLE.search(page)
    opened = page.find(">", start.end()) if start else -1
    end = TITLE_END.search(page, opened) if opened >= 0 else None
    return " ".join(html.unescape(page[opened + 1 : end.start()]).split()) if end else None


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """(status, headers, body); (None, [], block) if there is no HTTP head."""
    m = re.match(rb"HTTP/\d(?:\.\d)? (\d{3})[^\r\n]*\r?\n", block)
    end = re.search(rb"\r?\n\r?\n", block)
    if not m or not end:
        return None, [], block
    head = block[m.end() : end.start()].decode("latin-1")
    return int(m[1]), [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in head.splitlines()) if k.strip()], block[end.end() :]


def derived(record_id: str | None, uri: str | None, date: str | None, block: bytes | None) -> Iterator[tuple]:
    """The metadata and the conversion record of a response."""
    block = block or b""
    status, headers, body = split_http(block)
    charset = next((m[1] for k, v in headers if k.lower() == "content-type" and (m := re.search(r"charset=([\w-]+)", v))), "utf-8")
    try:
        page = body.decode(charset, errors="replace")
    except LookupError:
        page = body.decode("utf-8", errors="replace")
    kept = json.dumps(headers, ensure_ascii=False)
    text, links = scan(page)
    meta = {"status": status, "headers": headers, "payload_digest": digest(body), "payload_length": len(body), "title": title_of(page), "links": links}
    for kind, content_type, data in (("metadata", "application/json", json.dumps(meta, ensure_ascii=False).encode()), ("conversion", "text/plain; charset=utf-8", text.encode())):
        yield named(kind, record_id), kind, uri, date, record_id, content_type, digest(data), digest(body), kept, len(data), data


def derive(responses: DataFrame, rows_a_batch: int = 500) -> DataFrame:
    """From (record_id, target_uri, date, block): all their derived records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_a_batch):
                rows = batch.slice(at, rows_a_batch).to_pylist()
                out = [x for r in rows for x in derived(r["record_id"], r["target_uri"], r["date"], r["block"])]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], ARROW[t]) for j, (_, t) in enumerate(FIELDS)], [n for n, _ in FIELDS])

    return responses.select("record_id", "target_uri", "date", F.col("block").cast("binary").alias("block")).mapInArrow(run, SCHEMA)


def responses_of(pages: DataFrame) -> DataFrame:
    """Response records of a table (page_id, url, html)."""
    page = F.coalesce(F.col("html"), F.lit(""))
    key = F.md5(F.concat_ws(" ", F.lit("response"), F.col("page_id").cast("string")))
    rid = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", rid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(DATE).alias("date"), F.concat(head, page).cast("binary").alias("block"))


def serialize(record: dict) -> bytes:
    """One record as WARC/1.1 bytes."""
    block = record["block"] or b""
    fields = [("WARC-Type", record["type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["date"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Refers-To", record.get("refers_to")), ("WARC-Block-Digest", record.get("block_digest")), ("WARC-Payload-Digest", record.get("payload_digest")), ("Content-Type", record.get("content_type")), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(source: bytes | IO[bytes]) -> Iterator[dict]:
    """Records of a file or its bytes, one at a time; what is not a record is skipped and told as one of type "unreadable"."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    skipped = 0

    def unreadable() -> dict:
        return {n: None for n, _ in FIELDS} | {"type": "unreadable", "content_length": skipped}

    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                skipped += len(line) if line.strip() or skipped else 0
                continue
            raw, head = [line], {}
            while (line := stream.readline()).strip():
                raw.append(line)
                name, colon, value = line.decode("utf-8", errors="replace").partition(":")
                head[name.strip().lower()] = value.strip()
            size = head.get("content-length", "")
            block = stream.read(int(size)) if line and size.isascii() and size.isdigit() else None
            if block is None or len(block) < int(size):
                skipped += sum(map(len, raw)) + len(line) + len(block or b"")
                continue
            if skipped:
                yield unreadable()
                skipped = 0
            yield {"record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to": head.get("warc-refers-to"), "content_type": head.get("content-type"), "block_digest": head.get("warc-block-digest"), "payload_digest": head.get("warc-payload-digest"), "source_headers": None, "content_length": len(block), "block": block}
    except (EOFError, OSError, zlib.error):  # the compressed stream ends early or is damaged
        skipped += 1
    if skipped:
        yield unreadable()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed or gzipped WARC files. A file is read by one task, decompressed as it goes, in batches of
    about BATCH bytes; its compressed bytes are one value of that task: keep files to about 1 GB, as is usual."""

    def batch_of(records: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], ARROW[t]) for n, t in FIELDS], [n for n, _ in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in (x for batch in batches for x in batch.column(0)):
            data = io.BytesIO(raw.as_buffer())
            packed = raw.as_buffer()[:2].to_pybytes() == b"\x1f\x8b"
            held, size = [], 0
            for record in parse(gzip.GzipFile(fileobj=data) if packed else data):
                held.append(record)
                size += record["content_length"]
                if size >= BATCH:
                    yield batch_of(held)
                    held, size = [], 0
            yield batch_of(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def write_records(records: DataFrame, path: str) -> None:
    """One Parquet row of serialized bytes per record, in files that concatenate to WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([serialize(r) for r in batch.to_pylist()], pa.binary())], ["value"])

    records.mapInArrow(run, "value binary").write.parquet(path)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return derive(responses_of(pages)).withColumn("block", F.col("block").cast("string"))
