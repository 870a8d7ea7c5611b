"""WARC derivatives: metadata and plain-text conversion records linked to response records.

Each response (WARC/1.1, ISO 28500:2017) gives one ``metadata`` record (application/warc-fields) with the source's
headers, digests, title and outlinks, and one ``conversion`` record (text/plain) with its visible text.  Both refer
to the response by WARC-Refers-To and keep its target URI and date; digests are SHA-1 in base 32.
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
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
#: Date of records made from tables that have none.
DEFAULT_DATE = "2024-01-01T00:00:00Z"
SCHEMA = "id string, kind string, record_id string, refers_to string, target_uri string, date string, source_type string, source_status int, source_block_digest string, source_payload_digest string, block_digest string, content_length bigint, n_links int, record binary"

#: HTML elements that begin a new line of text.
BLOCKS = frozenset("address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
#: HTML elements whose content is no text.
UNSEEN = "script|style|template|noscript|svg|iframe|object|textarea"
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({UNSEEN})\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*+>", re.S | re.I)
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TITLE = re.compile(r"<title\b[^>]*+>(.*?)</title\s*>", re.S | re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream: io.BufferedIOBase, skipped: list[str] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an uncompressed WARC stream.

    What is no record is left out, up to the next line that begins one, and its fault added to ``skipped``: bytes
    before a version line, a Content-Length that is missing or no number, a block shorter than it says, or one behind which
    neither an empty line nor a record begins while a record begins within it.
    """
    skipped = [] if skipped is None else skipped
    line = stream.readline()
    while line:
        if not line.startswith(b"WARC/"):
            if line.strip():
                skipped.append("no version line")
            while line and not line.startswith(b"WARC/"):
                line = stream.readline()
            continue
        headers: dict[str, str] = {}
        last = None
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            if line[:1] in b" \t" and last:
                headers[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        length = headers.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            skipped.append("no content length")
        else:
            block = stream.read(int(length))
            line = stream.readline()
            short = len(block) < int(length)
            within = re.search(rb"\nWARC/\d", block) if short or not (line in (b"\r\n", b"\n", b"") or line.startswith(b"WARC/")) else None
            if short or within:
                skipped.append("truncated block" if short else "block beyond its record")
            else:
                yield headers, block
            if within:  # go on with the record that the block ran into
                stream = io.BytesIO(block[within.start() + 1 :] + line + stream.read())
                line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            continue
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()


def unchunked(body: bytes) -> bytes:
    """The data of a chunked transfer coding; what does not follow the coding ends it."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size) or int(size, 16) == 0:
            break
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)
    return b"".join(out)


def decoded(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without transfer and content codings (chunked, gzip, deflate); as it is where it does not follow them."""
    value = {k.lower(): v.lower() for k, v in fields}
    body = unchunked(payload) if "chunked" in value.get("transfer-encoding", "") else payload
    for coding in reversed([x.strip() for x in value.get("content-encoding", "").split(",")]):
        wbits = {"gzip": [47], "x-gzip": [47], "deflate": [15, -15]}.get(coding, [])
        for bits in wbits:
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
    return body or payload


def response(page_id: object, url: str | None, body: str | None, date: str = DEFAULT_DATE) -> bytes:
    """A response record for a stored page; its identifier follows from the page's id and URL."""
    payload = (body or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"response {page_id} {url}")
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date)]
    if url:
        headers.append(("WARC-Target-URI", re.sub(r"\s+", "%20", url)))
    headers += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return serialise(headers, block)


def visible_text(page: str) -> tuple[str, list[str]]:
    """(text with one line for each block that has any, links in order of appearance)."""
    links: list[str] = []

    def tag(m: re.Match) -> str:
        name = m[3]
        if name is None:
            return " " if m[1] else ""
        name = name.lower()
        if name == "a" and not m[2]:
            found = HREF.search(m[4])
            if found:
                links.append(html.unescape(found[1] or found[2] or found[3] or ""))
        return "\n" if name in BLOCKS else ""

    text = html.unescape(TAG.sub(tag, re.sub(r"[\r\n]+", " ", page)))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line), links


def derive(headers: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and conversion record of one response, as rows of SCHEMA without id."""
    head, _, payload = block.partition(b"\r\n\r\n")
    http = head.decode("latin-1").split("\r\n")
    status = re.match(r"HTTP/\S+\s+(\d+)", http[0])
    fields = [tuple(x.strip() for x in line.split(":", 1)) for line in http[1:] if ":" in line]
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    body = decoded(fields, payload)
    charset = CHARSET.search(kind) or CHARSET.search(body[:2048].decode("latin-1"))
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, ValueError):  # no such charset, or one that can't be replaced into text
        page = body.decode("utf-8", "replace")
    text, links = visible_text(page)
    title = TITLE.search(page)
    source, uri, date = headers.get("warc-record-id", ""), headers.get("warc-target-uri"), headers.get("warc-date", DEFAULT_DATE)
    block_digest = headers.get("warc-block-digest") or digest(block)
    payload_digest = headers.get("warc-payload-digest") or digest(payload)
    about = [("source-status", status[1] if status else ""), *[(f"source-header-{k.lower()}", v) for k, v in fields], ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("charset", charset[1].lower() if charset else "utf-8")]
    if title:
        about.append(("title", " ".join(html.unescape(title[1]).split())))
    about += [("outlink", " ".join(x.split())) for x in links]
    bodies = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in about).encode()), "conversion": ("text/plain; charset=utf-8", text.encode())}
    names = {k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{k} {source}')}>" for k in bodies}
    out = []
    for what, (content, text_) in bodies.items():
        own = digest(text_)
        lines = [("WARC-Type", what), ("WARC-Record-ID", names[what]), ("WARC-Refers-To", source), ("WARC-Date", date)]
        if uri:
            lines.append(("WARC-Target-URI", uri))
        if what == "metadata":
            lines.append(("WARC-Concurrent-To", names["conversion"]))
        lines += [("WARC-Block-Digest", own), ("Content-Type", content)]
        out.append({"kind": what, "record_id": names[what], "refers_to": source, "target_uri": uri, "date": date, "source_type": kind, "source_status": int(status[1]) if status else None, "source_block_digest": block_digest, "source_payload_digest": payload_digest, "block_digest": own, "content_length": len(text_), "n_links": len(links), "record": serialise(lines, text_)})
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DEFAULT_DATE) -> DataFrame:
    """(id, record): a response record for each page.  A null page has an empty payload, a null URL no target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, pages_ = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([response(i, u, h, date) for i, u, h in zip(ids, urls, pages_, strict=True)], pa.binary())], names=["id", "record"])

    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("u"), F.col(html_col).alias("h")).mapInArrow(run, "id string, record binary")


def derivatives(records: DataFrame, id_col: str = "id", record_col: str | Column = "record") -> DataFrame:
    """Two rows of SCHEMA, metadata and conversion, for every response among the given WARC records.

    ``record`` holds the bytes of one record or of several; records of other types, null ones and what is no record give
    nothing (``malformed`` counts the last).
    A map: repeated rows give repeated rows, an empty table an empty one.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for headers, block in parse(io.BytesIO(raw or b"")):
                    if headers.get("warc-type") == "response":
                        rows += [{"id": i, **row} for row in derive(headers, block)]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    record = F.col(record_col) if isinstance(record_col, str) else record_col
    assert names == ARROW.names
    return records.select(F.col(id_col).cast("string").alias("id"), record.alias("record")).mapInArrow(run, SCHEMA)


def malformed(records: DataFrame, id_col: str = "id", record_col: str = "record") -> DataFrame:
    """(id, fault, n): how often each row's bytes hold something that is no record, by fault; rows without faults give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, faults = [], []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: list[str] = []
                for _ in parse(io.BytesIO(raw or b""), found):
                    pass
                ids += [i] * len(found)
                faults += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(faults, pa.string())], names=["id", "fault"])

    rows = records.select(F.col(id_col).cast("string").alias("id"), F.col(record_col).alias("record")).mapInArrow(run, "id string, fault string")
    return rows.groupBy("id", "fault").agg(F.count("*").alias("n"))


_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
ARROW = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in SCHEMA.split(", ")])


def _unzipped(content: bytes) -> bytes:
    """The data of gzip members, up to where they are cut off or damaged."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            for lo in range(0, len(content), 1 << 16):
                out.append(member.decompress(content[lo : lo + (1 << 16)]))
                if member.eof:
                    content = member.unused_data + content[lo + (1 << 16) :]
                    break
            else:
                break
        except zlib.error:
            break
    return b"".join(out)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, record): the records of WARC files, plain or gzipped; ``id`` is file and number of the record.

    Of a gzipped file that is cut off or damaged the records before that place are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stream = io.BytesIO(_unzipped(content) if content[:2] == b"\x1f\x8b" else content)
                for n, (headers, block) in enumerate(parse(stream)):
                    raw = serialise([(k, v) for k, v in headers.items() if k != "content-length"], block)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{name}#{n}"]), pa.array([raw], pa.binary())], names=["id", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "id string, record binary")
