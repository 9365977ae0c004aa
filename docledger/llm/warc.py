"""WARC derivatives: a metadata and a plain-text conversion record for every response.

Each derived record refers to its response by ``WARC-Refers-To``, keeps the response's
target URI, date and further source headers, and carries the response's payload and block
digests next to its own block digest. Metadata records refer to both by JSON; the two derived
records name each other by ``WARC-Concurrent-To``. Record ids are name-based, so a task
that runs again makes the same records.

Defined cases: a null block is an empty one, and one without an HTTP head is all payload; a
null target URI or date leaves that header out; other records than responses give
nothing; repeated responses give repeated derivatives; broken HTML never fails: what is not
a tag is text, an unclosed tag, comment or script ends with the text. A charset that Python cannot decode
text by is read as UTF-8 with replacement characters. A header that stands more than once in a record keeps
all its values, one a line; in an HTTP head they are joined by commas. Other columns are ignored.

Reading never fails on one record: what cannot be read becomes a row of type ``problem`` whose headers tell
``Problem`` and ``Offset`` (in the uncompressed stream), and reading goes on at the next record, or ends where a
compressed member is cut off. A file is one binary value, so files must stay below 2 GB.
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

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm._text import small

CRLF = b"\r\n"
#: Source headers that go to derived records as they are.
KEPT = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type")
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
SKIPPED = ("script", "style", "noscript", "template")
#: Bytes of blocks that one batch of records should hold.
BATCH_BYTES = 8 << 20
RECORD = "record_id string, type string, headers map<string,string>, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """(status line, headers, payload) of an HTTP response block."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return "", {}, block
    first, *lines = head.decode("latin-1").split("\r\n")
    return first, _collected((x.partition(":") for x in lines), ", "), payload


def _collected(pairs, sep: str) -> dict[str, str]:
    """Header fields by name; the values of a repeated name (in any case) are joined by ``sep``."""
    out: dict[str, str] = {}
    named: dict[str, str] = {}
    for k, _, v in pairs:
        if k := k.strip():
            k = named.setdefault(k.lower(), k)
            out[k] = f"{out[k]}{sep}{v.strip()}" if k in out else v.strip()
    return out


def extract(page: str) -> tuple[str, str, list[tuple[str, str]]]:
    """(title, plain text, [(href, anchor text)]) in one pass over the page."""
    parts: list[str] = []
    title, links, href, anchor_at, title_at = "", [], None, 0, None
    at, n, low = 0, len(page), page.lower()
    if len(low) != n:  # a few letters change their length; tag names are ASCII
        low = "".join(c.lower() if c.isascii() else c for c in page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            parts.append(html.unescape(page[at:]))
            break
        if lt > at:
            parts.append(html.unescape(page[at:lt]))
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if not (nxt.isalpha() and nxt.isascii() or nxt in ("/", "!", "?")):
            parts.append("<")
            at = lt + 1
            continue
        gt = page.find(">", lt)
        if gt < 0:
            break
        inner, at = page[lt + 1 : gt], gt + 1
        name = inner.lstrip("/").split(None, 1)[0].rstrip("/").lower() if inner.strip("/ \t\r\n") else ""
        closing = inner.startswith("/")
        if name in SKIPPED and not closing:
            end = low.find(f"</{name}", at)
            gt = page.find(">", end) if end >= 0 else -1
            at = n if gt < 0 else gt + 1
            continue
        if name == "title":
            if closing and title_at is not None:
                title = title or " ".join("".join(parts[title_at:]).split())
                title_at = None
            elif not closing:
                title_at = len(parts)
        if name == "a":
            if href is not None:
                links.append((href, " ".join("".join(parts[anchor_at:]).split())))
                href = None
            if not closing:
                href, anchor_at = attribute(inner, "href"), len(parts)
        if name in BREAKS:
            parts.append("\n")
    if href is not None:
        links.append((href, " ".join("".join(parts[anchor_at:]).split())))
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return title, "\n".join(x for x in lines if x), links


def attribute(tag: str, name: str) -> str | None:
    """The value of an attribute in a tag's inside, with entities decoded."""
    low, at = tag.lower(), 0
    while (at := low.find(name, at)) >= 0:
        before, rest = low[at - 1 : at], tag[at + len(name) :].lstrip()
        at += len(name)
        if before in ("", " ", "\t", "\n", "\r", "/", '"', "'") and rest.startswith("="):
            rest = rest[1:].lstrip()
            quote = rest[:1]
            value = rest[1:].split(quote, 1)[0] if quote in ('"', "'") and quote else (rest.split(None, 1) or [""])[0]
            return html.unescape(value)
    return None


def decoded(payload: bytes, headers: dict[str, str]) -> str:
    """A payload's text by the charset of its headers; UTF-8 where there is none, or none that decodes text."""
    kind = next((v for k, v in headers.items() if k.lower() == "content-type"), "")
    name = kind.lower().partition("charset=")[2].split(";")[0].split(",")[0].strip(" \"'")
    try:
        return payload.decode(name or "utf-8", errors="replace")
    except (LookupError, ValueError):  # unknown, no text encoding, or one that refuses these bytes
        return payload.decode("utf-8", errors="replace")


def derive(rid: str, headers: dict[str, str], block: bytes) -> list[tuple[str, str, dict[str, str], bytes]]:
    """The metadata and the conversion record of one response."""
    status, http, payload = split_http(block)
    title, text, links = extract(decoded(payload, http))
    source = {k: v for k, v in headers.items() if v is not None}
    own = {"payload": source.get("WARC-Payload-Digest") or digest(payload), "block": source.get("WARC-Block-Digest") or digest(block)}
    ids = {kind: record_id(kind, rid) for kind in ("metadata", "conversion")}
    body = {"refers-to": rid, "source-headers": source, "source-digests": own, "http-status": status, "http-headers": http, "title": title, "links": [{"url": u, "text": t} for u, t in links], "conversion": ids["conversion"]}
    bodies = {"metadata": ("application/json", json.dumps(body, ensure_ascii=False, sort_keys=True).encode(errors="replace")), "conversion": ("text/plain; charset=utf-8", text.encode(errors="replace"))}
    out = []
    for kind, (mime, data) in bodies.items():
        head = {"WARC-Type": kind, "WARC-Record-ID": ids[kind], "WARC-Refers-To": rid}
        head |= {k: source[k] for k in KEPT if k in source}
        head |= {"WARC-Concurrent-To": ids["conversion" if kind == "metadata" else "metadata"], "WARC-Source-Payload-Digest": own["payload"], "WARC-Source-Block-Digest": own["block"]}
        head |= {"WARC-Block-Digest": digest(data), "Content-Type": mime, "Content-Length": str(len(data))}
        out.append((ids[kind], kind, head, data))
    return out


def serialise(headers: dict[str, str], block: bytes, compress: bool = False) -> bytes:
    """One record as bytes; compressed, one gzip member with a fixed time."""
    lines = [f"{k}: {' '.join(v.split(chr(13)))}".encode() for k, all_of in headers.items() for v in str(all_of).split("\n")]
    out = CRLF.join([b"WARC/1.0", *lines, b"", block]) + CRLF + CRLF
    return gzip.compress(out, mtime=0) if compress else out


class _Counted:
    """A stream that knows how far it was read; a broken gzip member ends it and is remembered."""

    def __init__(self, data: bytes):
        self.of = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
        self.at, self.problem = 0, None

    def _read(self, fn, *args) -> bytes:
        try:
            got = fn(*args) if self.problem is None else b""
        except (OSError, EOFError, zlib.error) as e:
            self.problem, got = f"{type(e).__name__}: {e}", b""
        self.at += len(got)
        return got

    def line(self) -> bytes:
        return self._read(self.of.readline)

    def take(self, n: int) -> bytes:
        return self._read(self.of.read, n)


def _problem(what: str, offset: int) -> tuple[dict[str, str], bytes]:
    return {"WARC-Type": "problem", "Problem": what, "Offset": str(offset)}, b""


def parse(data: bytes):
    """(headers, block) of every record of a WARC file, plain or gzip by member; see the module for what is broken."""
    stream = _Counted(data)
    while line := stream.line():
        if not line.startswith(b"WARC/"):
            continue
        start, lines = stream.at - len(line), []
        while (line := stream.line()) not in (b"", b"\n", CRLF):
            lines.append(line.decode("utf-8", errors="replace").partition(":"))
        headers = _collected(lines, "\n")
        length = next((v for k, v in headers.items() if k.lower() == "content-length"), "0")
        if not re.fullmatch("[0-9]{1,18}", length):
            yield _problem(f"Content-Length: {length[:100]}", start)
            continue
        block = stream.take(int(length))
        if len(block) < int(length):
            yield _problem(f"{len(block)} of {length} bytes", start)
        else:
            yield headers, block
    if stream.problem:
        yield _problem(stream.problem, stream.at)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    ids, kinds, heads, blocks = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string()), pa.array([list(h.items()) for h in heads], pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], names=["record_id", "type", "headers", "block"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, type, headers, block)`` of the WARC files at a path."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for headers, block in parse(data.as_py()):
                    rows.append((headers.get("WARC-Record-ID"), headers.get("WARC-Type"), headers, block))
                    size += len(block)
                    if len(rows) >= 1000 or size >= BATCH_BYTES:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Crawled pages as response records, with ``page_id``."""

    def run(batches):
        for b in small(batches):
            rows, ids = [], b.column(0)
            for page, url, body in zip(ids.to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                payload = body or b""
                block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode(), b"", payload])
                rid = record_id("response", str(page), url or "", date, digest(payload))
                head = {"WARC-Type": "response", "WARC-Record-ID": rid, **({"WARC-Target-URI": url} if url is not None else {}), "WARC-Date": date}
                head |= {"WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
                rows.append((rid, "response", head, block))
            if rows:
                out = _records(rows)
                yield pa.RecordBatch.from_arrays([ids, *out.columns], names=["page_id", *out.schema.names])

    cols = [F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html")]
    return pages.select(*cols).mapInArrow(run, f"page_id bigint, {RECORD}")


def derivatives(responses: DataFrame, key_col: str | None = None) -> DataFrame:
    """``(key, record_id, type, headers, block)``: two records for every response; key is ``key_col``'s value."""

    def run(batches):
        for b in small(batches):
            rows, keys = [], []
            for key, rid, kind, head, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind != "response":
                    continue
                got = derive(rid or record_id("unnamed", digest(block or b"")), dict(head or ()), block or b"")
                rows += got
                keys += [key] * len(got)
            if rows:
                out = _records(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *out.columns], names=["key", *out.schema.names])

    key = F.col(key_col).cast("bigint") if key_col else F.lit(None).cast("bigint")
    return responses.select(key.alias("key"), "record_id", "type", "headers", "block").mapInArrow(run, f"key bigint, {RECORD}")


def files(records: DataFrame, file_bytes: int = 1 << 28) -> DataFrame:
    """``(name, content)``: the records of each partition as compressed WARC files of about ``file_bytes``."""

    def run(batches):
        buffer, size, first = [], 0, None
        for b in batches:
            for rid, head, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first = first or rid
                buffer.append(serialise(dict(head), block, compress=True))
                size += len(buffer[-1])
                if size >= file_bytes:
                    yield _file(first, buffer)
                    buffer, size, first = [], 0, None
        if buffer:
            yield _file(first, buffer)

    return records.select("record_id", "headers", "block").mapInArrow(run, "name string, content binary")


def _file(first: str, parts: list[bytes]) -> pa.RecordBatch:
    name = f"{hashlib.sha1((first or '').encode()).hexdigest()[:20]}.warc.gz"
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], names=["name", "content"])


def digest_rows(pages: DataFrame) -> DataFrame:
    """``(page_id, type, record_id, refers_to, target_uri, content_length, block_digest, source_payload_digest, block)``."""
    out = derivatives(responses_of_pages(pages), "page_id")
    head = lambda k: F.element_at("headers", k)
    return out.select(
        F.col("key").alias("page_id"), "type", "record_id", head("WARC-Refers-To").alias("refers_to"), head("WARC-Target-URI").alias("target_uri"),
        head("Content-Length").cast("bigint").alias("content_length"), head("WARC-Block-Digest").alias("block_digest"),
        head("WARC-Source-Payload-Digest").alias("source_payload_digest"), F.col("block").cast("string").alias("block"),
    )
