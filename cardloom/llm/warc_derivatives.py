"""WARC derivatives: metadata and plain-text conversion records from responses.

Every response gives two linked records.  The ``metadata`` record keeps the HTTP status, all HTTP headers, the
source's identifiers and digests, and what the page says of itself (title, language, links).
The ``conversion`` record holds the page's plain text.  Both name the response in
``WARC-Refers-To`` and each other in ``WARC-Concurrent-To``, and keep the target URI and date.
(ISO 28500:2017, WARC 1.1.)

Records are compressed one by one, so a reader can begin at any of them.  Record ids follow from the
source's id, so repeated tasks write the same records; that of a response follows from its page, and of equal pages
from their places too, so no two records share an id.
"""

from __future__ import annotations

import base64
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.frames import parts
from cardloom.llm.words import slices
from cardloom.llm.workers import in_batches

VERSION = b"WARC/1.1"
#: A file is closed when it has so many bytes before compression.
FILE_BYTES = 64 << 20
#: Compression level of records.
LEVEL = 1
#: Bytes read at once; what follows a compressed member is copied, so not many.
READ_BYTES = 64 << 10

#: So many hashes of repeated keys are sent to the tasks (8 bytes each).
MOST_REPEATED = 100_000

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC digests are written."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An identifier that follows from the parts."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=4)}>"


def get(headers: Headers, name: str) -> str | None:
    """The first value of a header; names have no case."""
    return next((v for n, v in headers if n.lower() == name.lower()), None)


def by_name(headers: Headers) -> dict[str, str]:
    """The first value of each header, by its name in lower case."""
    return {n.lower(): v for n, v in reversed(headers)}


def pack(headers: Headers, block: bytes) -> bytes:
    """One compressed record; Content-Length is added."""
    head = "".join([f"{n}: {_line(v)}\r\n" for n, v in headers]).encode() + b"Content-Length: %d\r\n" % len(block)
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + c.flush()


def _line(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+\s*", " ", value) if "\n" in value or "\r" in value else value


def _members(stream: io.RawIOBase) -> Iterator[bytes]:
    """Decompressed chunks of a stream of compressed members, or the stream as it is."""
    data = stream.read(READ_BYTES)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(READ_BYTES)
        return
    d = zlib.decompressobj(31)
    while data:
        yield d.decompress(data)
        data = d.unused_data if d.eof else b""
        if d.eof:
            d = zlib.decompressobj(31)
        if not data:
            data = stream.read(READ_BYTES)


def records(stream: io.RawIOBase) -> Iterator[tuple[Headers, bytes]]:
    """The records of a WARC stream, compressed or not; one is held in memory at a time."""
    chunks, buffer = _members(stream), b""

    def need(n: int) -> bool:
        nonlocal buffer
        pieces, size = [buffer], len(buffer)
        while size < n:
            piece = next(chunks, None)
            if piece is None:
                break
            pieces.append(piece)
            size += len(piece)
        buffer = b"".join(pieces)
        return size >= n

    while True:
        while need(2) and buffer[:2] == b"\r\n":
            buffer = buffer[2:]
        if not buffer:
            return
        size = 4096
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not need(len(buffer) + size):
                if buffer.find(b"\r\n\r\n") < 0:
                    raise ValueError("a record's header does not end")
        first, *lines = buffer[:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = _headers(lines)
        length = int(by_name(headers).get("content-length") or 0)
        buffer = buffer[end + 4 :]
        if not need(length):
            raise ValueError("a record's block is cut off")
        yield headers, buffer[:length]
        buffer = buffer[length:]


def _headers(lines: list[str]) -> Headers:
    """Name and value of each line; a line that begins with white space goes on with the one before."""
    out: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def response(key: str, url: str | None, page: str | None, date: str, place: str = "") -> tuple[Headers, bytes]:
    """A page as a response record; ``place`` tells equal pages apart."""
    payload = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url or "", page or "", *([place] if place else []))), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", url)] if url else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload))]
    return headers, block


_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|title)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title|\Z)", re.S | re.I)
_LANGUAGE = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_META_CHARSET = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def plain_text(page: str) -> str:
    """All text of a page: a line for each block, white space folded, no empty lines."""
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", page))))
    return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata and the conversion record of a response; nothing of other records.

    A block that is no HTTP message is taken as the payload itself.  The HTTP header names the character set, else the
    first ``meta`` that does, else it is UTF-8 (as for an unknown one).  Undecodable bytes become U+FFFD.
    """
    given = by_name(headers)
    if given.get("warc-type") != "response":
        return []
    source, uri, date = given.get("warc-record-id") or "", given.get("warc-target-uri"), given.get("warc-date")
    status, http, payload = "", [], block
    if block.startswith(b"HTTP/"):
        head, _, payload = block.partition(b"\r\n\r\n")
        status, *lines = head.decode("latin-1").split("\r\n")
        http = _headers(lines)
    told, meta = _CHARSET.search(get(http, "Content-Type") or ""), _META_CHARSET.search(payload)
    try:
        page = payload.decode(told[1] if told else meta[1].decode() if meta else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    meta_id, text_id = record_id("metadata", source), record_id("conversion", source)
    title, language = _TITLE.search(page), _LANGUAGE.search(page)
    fields: Headers = [("source-record-id", source)]
    fields += [(f"source-{n.lower()}", v) for n, v in headers]
    own_digest = digest(payload)
    told_digest = given.get("warc-payload-digest") or own_digest
    fields += [("payload-digest", own_digest), ("payload-length", str(len(payload)))]
    fields += [("http-status", status)] if status else []
    fields += [(f"http-header-{n.lower()}", v) for n, v in http]
    fields += [("title", " ".join(html.unescape(title[1]).split()))] if title else []
    fields += [("language", language[1])] if language else []
    fields += [("outlink", html.unescape(a or b or c)) for a, b, c in _LINK.findall(page)]
    meta_block = "".join([f"{n}: {_line(v)}\r\n" for n, v in fields]).encode("utf-8", "replace")
    text_block = plain_text(page).encode("utf-8", "replace")
    out = []
    for kind, own, other, content, data in (("metadata", meta_id, text_id, "application/warc-fields", meta_block), ("conversion", text_id, meta_id, "text/plain; charset=utf-8", text_block)):
        made: Headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Concurrent-To", other)]
        made += [("WARC-Target-URI", uri)] if uri else []
        made += [("WARC-Date", date)] if date else []
        made += [("WARC-Refers-To-Target-URI", uri)] if uri else []
        made += [("WARC-Refers-To-Date", date)] if date else []
        made += [("Content-Type", content), ("WARC-Block-Digest", digest(data)), ("WARC-Source-Payload-Digest", told_digest)]
        out.append((made, data))
    return out


_FILES = "name string, n_records long"


def _written(rows: DataFrame, make, folder: str) -> None:
    """Write the records that ``make(batch)`` gives into files of ``folder``, listed in its manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            for record in make(batch):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(pack(*record))
                n, size = n + 1, size + len(record[1])
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"name": [name], "n_records": [n]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "n_records": [n]})

    in_batches(rows, write, _FILES).coalesce(max(1, parts(rows.sparkSession))).write.parquet(f"{folder}/manifest")


def _read(spark: SparkSession, folder: str, schema: str, turn) -> DataFrame:
    """Rows that ``turn(headers, block)`` gives for the records of a folder, a file at a time."""
    files = spark.read.parquet(f"{folder}/manifest").select("name").repartition(parts(spark), "name")
    fields = [f.split(" ") for f in schema.split(", ")]
    arrow = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in fields])

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for record in records(f):
                        for row in turn(*record):
                            rows.append(row)
                            size += len(record[1])
                        if size >= 1 << 20:
                            yield batched(rows)
                            rows, size = [], 0
                if rows:
                    yield batched(rows)

    return in_batches(files, read, schema)


def write_responses(pages: DataFrame, folder: str, date: str, key: str = "page_id", url: str = "url", page: str = "html") -> None:
    """Pages as response records in WARC files."""
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(page).alias("_html"))
    rows = rows.withColumn("_name", F.xxhash64("_key"))
    # Keys that occur more than once, told by hashes of 8 bytes; if there are very many, all pages are told apart by their places.
    again = [r["_name"] for r in rows.groupBy("_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_name").limit(MOST_REPEATED + 1).collect()]
    repeated, all_placed = frozenset(again), len(again) > MOST_REPEATED

    def make(batch: pa.RecordBatch) -> Iterator[tuple[Headers, bytes]]:
        for part in slices(batch, "_html"):
            for k, u, h, name, place in zip(*(part.column(c).to_pylist() for c in ("_key", "_url", "_html", "_name", "_place")), strict=True):
                headers, block = response("" if k is None else str(k), u, h, date, str(place) if all_placed or name in repeated else "")
                yield [*headers, *([("X-Source-Key", str(k))] if k is not None else [])], block

    _written(rows.withColumn("_place", F.monotonically_increasing_id()), make, folder)


def write_derivatives(spark: SparkSession, source: str, folder: str) -> None:
    """Derivative records of all responses in the files of ``source``."""
    files = spark.read.parquet(f"{source}/manifest").select("name").repartition(parts(spark), "name")

    def make(batch: pa.RecordBatch) -> Iterator[tuple[Headers, bytes]]:
        fs, base = pafs.FileSystem.from_uri(source)
        for name in batch.column("name").to_pylist():
            with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                for headers, block in records(f):
                    for made, data in derive(headers, block):
                        key = get(headers, "X-Source-Key")
                        yield [*made, *([("X-Source-Key", key)] if key else [])], data

    _written(files, make, folder)


DERIVED = "page_id string, url string, record_type string, record_id string, refers_to string, concurrent_to string, warc_date string, content_type string, block_digest string, source_payload_digest string, content_length long, block string"


def read_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each derivative record, with its block as text."""

    def turn(headers: Headers, block: bytes):
        given = by_name(headers)
        names = ("x-source-key", "warc-target-uri", "warc-type", "warc-record-id", "warc-refers-to", "warc-concurrent-to", "warc-date", "content-type", "warc-block-digest", "warc-source-payload-digest")
        yield (*(given.get(n) for n in names), len(block), block.decode("utf-8", "replace"))

    return _read(spark, folder, DERIVED, turn)


def derivatives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", key: str = "page_id") -> DataFrame:
    """Pages to responses, responses to derivatives, and the derivatives read back from their files.

    ``folder``: a URI that driver and executors share; ``responses`` and ``derivatives`` are made in it.

    Edge cases: a null page is an empty payload, a null url leaves the URI out, a null key leaves the key out;
    rows that are equal give a record each, with ids of their own; an empty table gives folders without files and an empty result;
    other columns are ignored.
    """
    spark = pages.sparkSession
    write_responses(pages, f"{folder}/responses", date, key)
    write_derivatives(spark, f"{folder}/responses", f"{folder}/derivatives")
    kind = dict(pages.dtypes)[key]
    return read_derivatives(spark, f"{folder}/derivatives").withColumn("page_id", F.col("page_id").cast(kind))
