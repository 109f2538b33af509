"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives a metadata record (application/warc-fields) and a conversion record
(text/plain).  Both refer to the response by its record id, carry its target URI and date,
and have digests of their own; the metadata record keeps the response's WARC and HTTP
headers and its digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.shipping import map_arrow

EPOCH = "2024-01-01T00:00:00Z"
Headers = list[tuple[str, str]]

_DROPPED = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)")
#: The inside of a tag; quotes hold a value only behind =, elsewhere they are characters like others.
_PIECE = r"""(?:[^<>"'=]|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])"""
_BLOCK = re.compile(rf"(?is)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|section|article|header|footer|nav|main|aside|blockquote|pre|form|title|head|body|html|figure|option)\b{_PIECE}*+(>)?")
_TAG = re.compile(rf"(?s)</?[a-zA-Z!?]{_PIECE}*+(>)?")
_TITLE = re.compile(rf"(?is)<title\b{_PIECE}*+(>)?")
_TITLE_END = re.compile(r"(?i)</title\s*>")
_HTML = re.compile(rf"(?is)<html\b({_PIECE}*+)")
_LANG = re.compile(rf"(?is){_PIECE}*?(?<![\w:-])lang\s*=\s*[\"']?([a-zA-Z0-9-]++)")
_A = re.compile(rf"(?is)<a\b({_PIECE}*+)")
_HREF = re.compile(rf"(?is){_PIECE}*?(?<![\w:-])href\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>]++))")


_CHUNK_SIZE = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,12})[ \t]*(?:;.*)?", re.S)
#: Content types whose payload is text; others (images, archives ...) have no plain-text record.
_TEXTUAL = re.compile(r"text/|html|xml|json|javascript", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A record id that depends on parts alone, so that reruns agree."""
    return uuid.uuid5(uuid.NAMESPACE_URL, "\0".join(parts)).urn


def header(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _fields(head: bytes) -> Headers:
    out: Headers = []
    for line in head.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def serialize(headers: Headers, block: bytes) -> bytes:
    """One record as it stands in a file; Content-Length is made to fit."""
    lines = [f"{k}: {v}" for k, v in headers if k.lower() != "content-length"]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a WARC file, plain or gzipped by member; ends where a member breaks off."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        at = 0
        while not member.eof:
            held = member.unconsumed_tail or data[at : at + step]
            at += 0 if member.unconsumed_tail else step
            if not held:
                return
            try:
                yield member.decompress(held, step)
            except zlib.error:
                return
        data = member.unused_data + data[at:]


def read_records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record of a WARC file, plain or gzipped by member; stops where it breaks off.

    A gzipped file is taken piece by piece, so that one record is held at a time.
    """
    held, pieces = bytearray(), inflated(data)
    more = lambda: (piece := next(pieces, None)) is not None and (held.extend(piece) or True)
    while True:
        while (begin := held.find(b"WARC/1.")) < 0 or (end := held.find(b"\r\n\r\n", begin)) < 0:
            if begin < 0:
                del held[:-6]
            if not more():
                return
        headers = _fields(bytes(held[begin:end]).split(b"\r\n", 1)[-1])
        size = header(headers, "Content-Length")
        if size is None or not (size.isascii() and size.isdigit()):
            return
        stop = end + 4 + int(size)
        while len(held) < stop:
            if not more():
                return
        yield headers, bytes(held[end + 4 : stop])
        del held[:stop]


def cleared(payload: bytes, coding: str) -> bytes | None:
    """payload without one content coding; None if the coding is unknown or broken."""
    try:
        if coding in ("gzip", "x-gzip"):
            return gzip.decompress(payload)
        if coding == "deflate":
            try:
                return zlib.decompress(payload)
            except zlib.error:  # servers also send it without its frame
                return zlib.decompress(payload, -zlib.MAX_WBITS)
    except (OSError, EOFError, zlib.error):
        return None
    return payload if coding in ("", "identity") else None


def http_parts(block: bytes) -> tuple[str, Headers, bytes, bool]:
    """Status line, headers and payload of an HTTP response, and whether the payload is clear: chunks are joined and codings undone, the last first.

    A payload whose codings can't all be undone stays as it came.
    """
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, payload = block.partition(b"\n\n")
    status, _, rest = head.partition(b"\n")
    headers = _fields(rest)
    if (header(headers, "Transfer-Encoding") or "").lower() == "chunked":
        out, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            said = _CHUNK_SIZE.fullmatch(payload, at, end)
            size = int(said[1], 16) if said else 0
            if not size:  # the last chunk, or no size at all
                break
            out.append(payload[end + 2 : end + 2 + size])
            at = end + 4 + size
        payload = b"".join(out) if out else payload
    clear: bytes | None = payload
    for coding in reversed((header(headers, "Content-Encoding") or "").lower().split(",")):
        clear = None if clear is None else cleared(clear, coding.strip())
    return status.decode("latin-1").strip(), headers, payload if clear is None else clear, clear is not None


def plain_text(page: str) -> str:
    """Text of an HTML page: scripts, styles and comments go, block tags end lines, entities are resolved."""
    text = _DROPPED.sub(" ", page)
    # what begins a tag and has no end stays, and is passed as a whole, so that time follows the length
    text = html.unescape(_TAG.sub(lambda m: "" if m[1] else m[0], _BLOCK.sub(lambda m: "\n" if m[1] else m[0], text)))
    return "\n".join(x for line in text.split("\n") if (x := " ".join(line.split())))


def page_title(page: str) -> str | None:
    at = next((m.end() for m in _TITLE.finditer(page) if m[1]), None)
    if at is None:
        return None
    end = _TITLE_END.search(page, at)
    return page[at : end.start()] if end else page[at:]


def page_language(page: str) -> str | None:
    return next((found[1] for m in _HTML.finditer(page) if (found := _LANG.match(m[1]))), None)


def page_links(page: str) -> list[str]:
    return [found[1] or found[2] or found[3] or "" for m in _A.finditer(page) if (found := _HREF.match(m[1]))]


def decoded(payload: bytes, headers: Headers) -> tuple[str, str]:
    """Text and character set of a payload."""
    said = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", header(headers, "Content-Type") or "", re.I) or re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", payload[:2048].decode("latin-1"), re.I)
    charset = said[1].lower() if said else "utf-8"
    try:
        return payload.decode(charset, "replace"), charset
    except LookupError:
        return payload.decode("utf-8", "replace"), "utf-8"


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata and the conversion record of a response record; other record types give none.

    A payload whose content type isn't text (an image, say), or whose content coding is unknown or broken, has the
    metadata record alone, without charset and text fields.
    """
    if (header(headers, "WARC-Type") or "").lower() != "response":
        return []
    source, uri, date = (header(headers, f"WARC-{k}") for k in ("Record-ID", "Target-URI", "Date"))
    status, http, payload, clear = http_parts(block)
    page, charset = decoded(payload, http)
    kind_of = (header(http, "Content-Type") or "text/html").lower()
    textual = clear and bool(_TEXTUAL.search(kind_of))
    is_html = clear and "html" in kind_of
    text = plain_text(page) if is_html else page
    title = page_title(page) if is_html else None
    lang = page_language(page) if is_html else None
    links = [html.unescape(x) for x in page_links(page)] if is_html else []
    one_line = lambda x: " ".join(x.split())
    fields = [("http-status", status), ("charset", charset if textual else None), ("title", one_line(html.unescape(title)) if title is not None else None), ("language", lang)]
    fields += [("source-payload-digest", header(headers, "WARC-Payload-Digest") or digest(payload)), ("source-block-digest", header(headers, "WARC-Block-Digest") or digest(block))]
    fields += [("text-digest", digest(text.encode("utf-8", "replace"))), ("text-chars", str(len(text)))] if textual else []
    fields += [("source-warc-header", f"{k}: {one_line(v)}") for k, v in headers] + [("source-http-header", f"{k}: {one_line(v)}") for k, v in http]
    fields += [("outlink", one_line(x)) for x in links]
    out = []
    for kind, content_type, body in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        if kind == "conversion" and not textual:
            continue
        made = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(kind, source or '', digest(block))}>"), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", digest(body)), ("Content-Type", content_type), ("Content-Length", str(len(body)))]
        out.append(([(k, v) for k, v in made if v is not None], body))
    return out


def response(key: str, url: str | None, page: str | None, date: str = EPOCH) -> tuple[Headers, bytes]:
    """A response record for a page that was kept without its record; null page: no payload."""
    payload = (page or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    made = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id('response', key, url or '', digest(payload))}>"), ("WARC-Target-URI", " ".join(url.split()) if url else None), ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return [(k, v) for k, v in made if v is not None], block


COLUMNS = {"record_type": "string", "record_id": "string", "refers_to": "string", "target_uri": "string", "record_date": "string", "content_type": "string", "content_length": "long", "block_digest": "string", "source_digest": "string", "warc_headers": "string", "block": "string"}


def _row(headers: Headers, body: bytes, source_digest: str | None) -> tuple:
    get = lambda k: header(headers, k)
    return (get("WARC-Type"), get("WARC-Record-ID"), get("WARC-Refers-To"), get("WARC-Target-URI"), get("WARC-Date"), get("Content-Type"), len(body), get("WARC-Block-Digest"), source_digest, "".join(f"{k}: {v}\r\n" for k, v in headers), body.decode("utf-8", "replace"))


def derivatives(records: DataFrame, date: str = EPOCH) -> DataFrame:
    """Derived records of `records`: key long, and either headers string and block binary, or url and html.

    With url and html a response record is made first, dated by the column `fetched` (a string) if there is one, else by `date`.  A row gives a metadata and a
    conversion record, none if it isn't a response.  Null html counts as empty, a null url
    leaves the target out, and rows with equal keys are separate records.
    """
    own = {"headers", "block"} <= set(records.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                keys, rows = [], []
                for r in batch.slice(i, 500).to_pylist():
                    headers, block = (_fields((r["headers"] or "").encode()), r["block"] or b"") if own else response(str(r["key"]), r["url"], r["html"], r.get("fetched") or date)
                    for made, body in derive(headers, block):
                        keys.append(r["key"])
                        rows.append(_row(made, body, header(headers, "WARC-Payload-Digest")))
                columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(c, pa.int64() if t == "long" else pa.string()) for c, t in zip(columns, COLUMNS.values(), strict=True)]], names=["key", *COLUMNS])

    chosen = records.select(F.col("key").cast("long").alias("key"), *(("headers", "block") if own else ("url", "html", *(["fetched"] if "fetched" in records.columns else []))))
    return map_arrow(chosen, run, "key long, " + ", ".join(f"{k} {t}" for k, t in COLUMNS.items()))


def _some(records: Iterator[tuple[Headers, bytes]], size: int = 1 << 22) -> Iterator[list[tuple[Headers, bytes]]]:
    """Records in lists of about `size` bytes."""
    got, held = [], 0
    for r in records:
        got.append(r)
        held += len(r[1])
        if held >= size:
            yield got
            got, held = [], 0
    if got:
        yield got


def read_files(files: DataFrame) -> DataFrame:
    """Records of WARC files: content binary -> key long (0 for all), headers string, block binary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                for got in _some(read_records(data.as_py() or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array([0] * len(got), pa.int64()), pa.array(["".join(f"{k}: {v}\r\n" for k, v in h) for h, _ in got], pa.string()), pa.array([b for _, b in got], pa.binary())], names=["key", "headers", "block"])

    return map_arrow(files.select("content"), run, "key long, headers string, block binary")


def as_bytes(derived: DataFrame) -> DataFrame:
    """derived with record binary: each record as it stands in a file."""
    tail = F.concat(F.lit("WARC/1.1\r\n"), "warc_headers", F.lit("\r\n"), "block", F.lit("\r\n\r\n"))
    return derived.withColumn("record", tail.cast("binary"))
