"""WARC derivatives: from response records, linked metadata records (JSON) and plain-text conversion records.

A derivative refers to its response (WARC-Refers-To, with the response's target URI, date and payload digest kept), and carries a block digest of
its own. Record ids are name-based UUIDs of the response's id, so a rerun gives the same bytes. Each record is made from one row; there is no shuffle.

Nulls: a null url becomes ``urn:page:<id>``, null html an empty payload, a null id (or one that is no whole number) the word ``null``. Empty payloads give
an empty text. Repeated rows give repeated records. An empty table gives no records. A page is read in time linear in its length, broken markup included.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tidewater:warc")
#: Elements whose content is no text (a title goes to the metadata), and elements that break lines: fixed names of HTML.
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "textarea", "title")}
_BREAKS = set(
    "p div br hr li ul ol dl dt dd tr table h1 h2 h3 h4 h5 h6 article section header footer nav main aside blockquote pre form option body html head".split()
)
_LINKS = {"a", "link", "img", "area", "iframe"}
_NAME = re.compile(r"</?([a-zA-Z]\w*)")
_REF = re.compile(r"""\b(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)
_PLAIN = str.maketrans("\t\r\n\f", "    ")


def digest(data: bytes) -> str:
    return f"sha1:{base64.b32encode(hashlib.sha1(data).digest()).decode()}"


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record; the first header is ("", "WARC/1.0"). Raises ValueError where a record is broken."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        first, *rest = data[at:end].decode("utf-8").split("\r\n")
        headers = [("", first), *((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in rest))]
        size = int(next(v for k, v in headers if k.lower() == "content-length"))
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record's block doesn't end at byte {at}")
        yield headers, data[end + 4 : at]
        at += 4


def response(page_id, url: str | None, body: str | None) -> bytes:
    """A page as a response record."""
    payload = (body or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    name = "null" if page_id is None else str(page_id)
    target = re.sub(r"[\s\x00-\x1f]", "%20", url) if url else f"urn:page:{name}"
    rid = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{name} {target}')}>"
    return record("response", rid, [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")], http + payload)


def read_page(page: str) -> tuple[str, str | None, str | None, list[tuple[str, str, str]]]:
    """(visible text, title, language, links (tag, attribute, reference)) of a page, in one pass from left to right.

    Scripts, styles, comments and markup go, block elements break lines, white space is collapsed. Comments and raw elements that never
    close end with the page. A "<" that begins no markup, or markup for which no ">" follows, is text. Every search goes on where the last one
    ended, and a search that found nothing isn't made again, so the time is linear in the page.
    """
    out, title, lang, links = [], None, None, []
    at, n, close = 0, len(page), -1
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            break
        out.append(page[at:tag].translate(_PLAIN))
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            out.append(" ")
            at = n if end < 0 else end + 3
            continue
        name = _NAME.match(page, tag)
        hidden = name is None and (page.startswith("<?", tag) or page[tag : tag + 9].lower() == "<!doctype")
        if (name or hidden) and close < tag:
            close = page.find(">", tag)
            if close < 0:
                close = n  # none follows
        if not (name or hidden) or close == n:
            out.append("<")
            at = tag + 1
            continue
        at = close + 1
        if hidden:
            out.append(" ")
            continue
        kind, opens = name[1].lower(), page[tag + 1] != "/"
        if opens and kind in _RAW:
            end = _RAW[kind].search(page, at)
            if kind == "title" and title is None:
                title = " ".join(html.unescape(page[at : end.start() if end else n]).split())
            out.append(" ")
            at = end.end() if end else n
            continue
        if opens and kind in _LINKS:
            ref = _REF.search(page, name.end(), close)
            if ref:
                links.append((kind, ref[1].lower(), html.unescape(ref[2] or ref[3] or ref[4] or "").strip()))
        elif opens and kind == "html" and lang is None:
            found = _LANG.search(page, name.end(), close)
            lang = found[1] if found else None
        if kind in _BREAKS:
            out.append("\n")
    out.append(page[at:].translate(_PLAIN))
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), title, lang, links


def derive(warc: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(kind, record id, record) for the metadata and the conversion of each response in ``warc``."""
    for headers, block in parse(warc):
        h = {k.lower(): v for k, v in headers}
        if h.get("warc-type") != "response":
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        status, *fields = head.decode("latin-1").split("\r\n")
        http = [[k.strip(), v.strip()] for k, _, v in (x.partition(":") for x in fields)]
        charset = re.search(r"charset=([\w-]+)", next((v for k, v in http if k.lower() == "content-type"), ""))
        try:
            page = payload.decode(charset[1] if charset else "utf-8", "replace")
        except LookupError:
            page = payload.decode("utf-8", "replace")
        target, source = h.get("warc-target-uri", ""), h["warc-record-id"]
        text, title, lang, links = read_page(page)
        found = []
        for tag, attr, ref in links:
            try:
                found.append({"path": f"{tag.upper()}@/{attr}", "url": urljoin(target, ref)})
            except ValueError:
                found.append({"path": f"{tag.upper()}@/{attr}", "url": ref})
        body = {
            "envelope": {"warc-headers": [list(x) for x in headers[1:]], "format": headers[0][1], "actual-content-length": len(block), "block-digest": digest(block)},
            "http": {"status": status, "headers": http, "payload-length": len(payload), "payload-digest": digest(payload)},
            "html": {"title": title, "lang": lang, "links": found},
        }
        linked = [("WARC-Date", h.get("warc-date", DATE)), ("WARC-Target-URI", target), ("WARC-Refers-To", source)]
        linked += [("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", h.get("warc-date", DATE)), ("WARC-Source-Payload-Digest", h.get("warc-payload-digest", digest(payload)))]
        for kind, kind_type, out in (("metadata", "application/json", json.dumps(body, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
            rid = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {source}')}>"
            yield kind, rid, record(kind, rid, [*linked, ("Content-Type", kind_type)], out)


DERIVED = "page_id long, kind string, record_id string, refers_to string, target_uri string, source_payload_digest string, block_digest string, content_length long, record binary"


def derivatives(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Two rows a page (metadata and conversion) with the whole record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                yield pa.RecordBatch.from_pylist(list(_rows(b.slice(lo, 256))), schema=_SCHEMA)

    return pages.select(F.col(key).try_cast("long").alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html")).mapInArrow(run, DERIVED)


_SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in DERIVED.split(", "))])


def _rows(b: pa.RecordBatch) -> Iterable[dict]:
    for page_id, url, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
        for kind, rid, rec in derive(response(page_id, url, body)):
            headers, block = next(parse(rec))
            h = dict(headers)
            yield {
                "page_id": page_id, "kind": kind, "record_id": rid, "refers_to": h["WARC-Refers-To"], "target_uri": h["WARC-Target-URI"], "source_payload_digest": h["WARC-Source-Payload-Digest"],
                "block_digest": h["WARC-Block-Digest"], "content_length": len(block), "record": rec,
            }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, record number, type, record_id, record) of all records of WARC files, plain or gzip. A file is read by one task."""
    import gzip

    schema = "path string, n long, type string, record_id string, record binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = data.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                for n, (headers, block) in enumerate(parse(raw)):
                    h = dict(headers)
                    whole = "\r\n".join([headers[0][1], *(f"{k}: {v}" for k, v in headers[1:])]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
                    yield pa.RecordBatch.from_pydict({"path": [name], "n": pa.array([n], pa.int64()), "type": [h.get("WARC-Type")], "record_id": [h.get("WARC-Record-ID")], "record": [whole]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derivatives(table(spark, sf_dir, "pages"))
    return made.select("page_id", "kind", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))
