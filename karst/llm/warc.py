"""Web-archive derivatives: response records, and from each a metadata and a plain-text conversion record.

A response holds the HTTP header and the page; its metadata record (content type, charset, title, language, number of
links, the source's HTTP headers) and its conversion record (the page as plain text) refer to it by its record id, keep
its target URI and date, and carry SHA-1 digests of their own blocks; the conversion also repeats the digest of the
payload it was made from. Record ids are name-based (of URI, date and payload digest), so a task that runs again
writes the same records.

Records are rows with their bytes; `write_files` puts them into a table of gzip members, one member a record, and
`read_records` parses bytes back into rows. Every step is per page, so there is no shuffle.

Payloads are read in the charset of their HTTP header, else of their first 1,024 bytes, else as UTF-8, after chunked transfer and
gzip or deflate are undone; records of others may write header names in any case, without a space or folded, and may lack
a target URI, a date or an id, which are then empty in the derived records. Patterns never look past the next `<`, so a
page of unclosed tags takes time in proportion to its length.

Cases: a null page is an empty payload; a null URL makes an empty target URI; bytes that are not valid text become
replacement characters; unclosed tags, scripts, styles and comments end with the page, other unclosed elements
keep their text; null or repeated ids and pages make
records like others (equal ones get equal ids); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMESPACE = uuid.UUID("7d0e4f3c-53a1-4c83-9d0f-6b1f9e7c2a55")
DATE = "2000-01-01T00:00:00Z"
RECORD = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, record binary"

_OPEN = re.compile(r"<!--|<(script|style|noscript|template|svg)(?=[\s/>])", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg")}
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>", re.I)
_TAG = re.compile(r"<(?:[a-zA-Z/!?])[^<>]*(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_CHARSET = re.compile(r"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=", re.I)
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def _without_blocks(page: str) -> str:
    """A page without comments, scripts, styles, templates and drawings. Unclosed comments, scripts and styles end with
    the page; of other unclosed elements, and of an svg closed in its own tag, the tag alone goes."""
    parts, done, at, missing = [], 0, 0, set()  # missing: what no longer occurs behind here, so each is sought once
    while m := _OPEN.search(page, at):
        name = (m[1] or "").lower()
        if not name:
            end = page.find("-->", m.end()) + 3
            end = len(page) if end < 3 else end
        else:
            tag = 0 if ">" in missing else page.find(">", m.end()) + 1
            if not tag:
                missing.add(">")
                at = m.end()
                continue
            close = None
            if name == "svg" and page[tag - 2] == "/":
                end = tag
            elif name not in missing and (close := _CLOSE[name].search(page, tag)):
                end = close.end()
            elif name in ("script", "style"):
                end = len(page)
            else:
                missing.add(name)
                at = tag
                continue
        parts.append(page[done : m.start()])
        done = at = end
    return " ".join([*parts, page[done:]])


def plain_text(page: str) -> str:
    """A page without markup: block elements end lines, entities are resolved, white space is folded."""
    text = _without_blocks(page)
    text = _TAG.sub("", _BLOCK.sub("\n", text))
    text = _SPACES.sub(" ", html.unescape(text))
    return _LINES.sub("\n", text).strip()


def serialise(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Header names as this module writes them, by their lower-case form; others keep their own spelling.
_NAMES = {n.lower(): n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Source-Payload-Digest", "Content-Type", "Content-Length")}


def fields(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values of header lines: any space after the colon, folded lines joined, lines without a colon left out."""
    out: list[list[str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1][1] = f"{out[-1][1]} {line.strip()}".strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append([name.strip(), value.strip()])
    return [(n, v) for n, v in out]


def parse(data: bytes):
    """Yield (headers, block) of each record of a WARC stream; header names in any case, folded or not."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record begins here")
        headers = {_NAMES.get(n.lower(), n): v for n, v in reversed(fields(lines[1:]))}
        size = int(headers.get("Content-Length", "0"))
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, block
        at = end + 8 + size


def _unchunked(payload: bytes) -> bytes:
    """The payload of a chunked transfer; as it stands from where it is not one."""
    out, at = [], 0
    while (end := payload.find(b"\r\n", at)) >= 0:
        size = payload[at:end].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            break
        n = int(size, 16)
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 4 + n
        if n == 0:
            return b"".join(out)
    return b"".join(out) if out and at >= len(payload) else payload


def _unpacked(payload: bytes, coding: str) -> bytes:
    """Without gzip or deflate; as it stands if it is not what it says."""
    for name in reversed([c.strip().lower() for c in coding.split(",") if c.strip()]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(name, ()):
            try:
                payload = zlib.decompressobj(bits).decompress(payload)
                break
            except zlib.error:
                continue
    return payload


def _decoded(payload: bytes, content_type: str) -> str:
    """The text of a page in the charset that its header names, else the one in its own first 1,024 bytes, else UTF-8."""
    said = re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", content_type, re.I) or _CHARSET.search(payload[:1024].decode("latin-1"))
    for name in (said[1] if said else "utf-8", "utf-8"):
        try:
            return payload.decode(name, "replace")
        except (LookupError, UnicodeError):
            continue
    return payload.decode("latin-1")


def response(url: str, page: str, date: str = DATE) -> bytes:
    """The response record of a page."""
    payload = page.encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", record_id("response", url, date, digest(payload))), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(http + payload)), ("Content-Type", "application/http; msgtype=response")]
    return serialise("response", headers, http + payload)


def derive(headers: dict[str, str], block: bytes) -> list[bytes]:
    """The metadata and the conversion record of a response."""
    http, _, payload = block.partition(b"\r\n\r\n")
    status, *rest = http.decode("latin-1").split("\r\n")
    told = {k.lower(): v for k, v in fields(rest)}
    if "chunked" in told.get("transfer-encoding", "").lower():
        payload = _unchunked(payload)
    page = _decoded(_unpacked(payload, told.get("content-encoding", "")), told.get("content-type", ""))
    source, url, date = headers.get("WARC-Record-ID", ""), headers.get("WARC-Target-URI", ""), headers.get("WARC-Date", "")
    kept = headers.get("WARC-Payload-Digest") or digest(payload)
    title, lang, charset = _TITLE.search(page), _LANG.search(page), _CHARSET.search(page)
    known = {"title": " ".join(html.unescape(title[1]).split()) if title else "", "lang": lang[1] if lang else "", "charset": charset[1] if charset else "", "links": str(len(_LINK.findall(page))), "http-status": status, **{f"http-{k}": v for k, v in told.items()}}
    linked = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", url), ("WARC-Date", date)]
    out = []
    for kind, kind_of, own in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in known.items()).encode()), ("conversion", "text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace"))):
        out.append(serialise(kind, [("WARC-Record-ID", record_id(kind, source)), *linked, ("WARC-Source-Payload-Digest", kept), ("WARC-Block-Digest", digest(own)), ("Content-Type", kind_of)], own))
    return out


def _row(page_id, record: bytes) -> tuple:
    headers, _ = next(parse(record))
    get = headers.get
    return page_id, get("WARC-Type"), get("WARC-Record-ID"), get("WARC-Refers-To"), get("WARC-Target-URI"), get("WARC-Date"), get("Content-Type"), int(get("Content-Length")), get("WARC-Block-Digest"), get("WARC-Payload-Digest") or get("WARC-Source-Payload-Digest"), record


def _batch(rows):
    import pyarrow as pa

    kinds = (pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.string(), pa.binary())
    names = [c.split()[0] for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def responses(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> response records."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield _batch([_row(i, response(u or "", p or "")) for i, u, p in zip(*(c.to_pylist() for c in part.columns), strict=True)])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """Response records (page_id, record) -> their metadata and conversion records; other kinds make none."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = []
                for page_id, record in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for headers, block in parse(record or b""):
                        if headers.get("WARC-Type") == "response":
                            rows += [_row(page_id, r) for r in derive(headers, block)]
                yield _batch(rows)

    return records.select("page_id", "record").mapInArrow(run, RECORD)


def write_files(records: DataFrame, path: str) -> None:
    """Write records as gzip members, one a row; concatenated in any order they are a WARC file."""

    def run(batches):
        import gzip

        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([gzip.compress(r, mtime=0) for r in part.column(1).to_pylist()], pa.binary())], ["page_id", "member"])

    records.select("page_id", "record").mapInArrow(run, "page_id long, member binary").write.option("compression", "none").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Read the records of `write_files`."""

    def run(batches):
        import gzip

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield _batch([_row(i, gzip.decompress(m)) for i, m in zip(*(c.to_pylist() for c in part.columns), strict=True)])

    return spark.read.parquet(path).select("page_id", "member").mapInArrow(run, RECORD)
