"""WARC derivatives: for each response a linked metadata record and a plain-text conversion record.

Both refer to the response by its record id, and carry its target, its date and its digests. Ids
of derived records are made from the response's id, so a task that runs again makes the same ones.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswing.llm.common import short_batches, text_of
from glasswing.llm.tokenbin import _put, _store

VERSION = "WARC/1.1"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
RECORD = "record_id string, type string, uri string, date string, headers array<struct<name:string,value:string>>, block binary"

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[!/?A-Za-z][^<>]*>")
_BLANK = re.compile(r"[^\S\n]+")
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s<>\"']+))", re.I)
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """The text of a page: a line for each block, without scripts, styles, comments and tags."""
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page))))
    return "\n".join(x for x in (_BLANK.sub(" ", line).strip() for line in text.splitlines()) if x)


def links(page: str) -> list[str]:
    """Targets of a page's links in order, each once."""
    return list(dict.fromkeys(html.unescape(a or b or c).strip() for a, b, c in _LINK.findall(_HIDDEN.sub(" ", page))))


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of a response's block; a block without headers is all payload. Lines may end in a bare LF."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    end = _HEAD_END.search(block)
    head, payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    status, *lines = re.split(r"\r?\n", head.decode("latin-1"))
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def unchunked(payload: bytes) -> bytes:
    """The payload of a chunked transfer; what a damaged one holds up to the damage."""
    out, at = [], 0
    while (end := payload.find(b"\r\n", at)) >= 0:
        try:
            size = int(payload[at:end].partition(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(payload[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def inflated(payload: bytes, coding: str) -> bytes:
    """The payload without a content coding, all its gzip members; as it is where the coding isn't known or doesn't fit.

    What follows the last whole member and is none itself is left out. The whole payload is held.
    """
    bits = {"gzip": 31, "x-gzip": 31, "deflate": 47}.get(coding.strip().lower())
    if bits is None:
        return payload
    for wbits in (bits, -15):  # some servers send bare deflate data
        out, left = [], payload
        try:
            while left:
                member = zlib.decompressobj(wbits)
                out.append(member.decompress(left))
                left = member.unused_data if bits == 31 else b""
            return b"".join(out)
        except zlib.error:
            if out:
                return b"".join(out)
    return payload


def entity(http: list[tuple[str, str]], payload: bytes) -> bytes:
    """What a response's payload stands for: without its transfer and its content codings."""
    own = {k.lower(): v for k, v in http}
    if "chunked" in own.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    for coding in reversed(own.get("content-encoding", "").split(",")):
        payload = inflated(payload, coding)
    return payload


def decoded(payload: bytes, content_type: str) -> str:
    found = _CHARSET.search(content_type.encode("latin-1", "replace")) or _CHARSET.search(payload[:2048])
    try:
        return payload.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derived(record_id: str, uri: str, date: str, headers: list[tuple[str, str]], block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, http, payload = split_http(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "text/html").lower()
    source = dict(headers)
    page = decoded(entity(http, payload), kind) if re.match(r"text/|application/(?:xhtml\+)?xml", kind, re.I) else ""
    text = plain_text(page) if "html" in kind or "xml" in kind else page
    fields = [("source-http-status", status.partition(" ")[2])] + [(f"source-http-{k.lower()}", v) for k, v in http]
    fields += [(f"source-{k.lower()}", v) for k, v in headers] + [("outlink", f"{x} L a/@href") for x in links(page)]
    bodies = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode("utf-8", "replace")),
        "conversion": ("text/plain; charset=utf-8", text.encode("utf-8", "replace")),
    }
    out = []
    for name, (content, body) in bodies.items():
        own = f"<urn:uuid:{uuid.uuid5(SPACE, f'{name} {record_id}')}>"
        head = [("WARC-Refers-To", record_id), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Block-Digest", digest(body)), ("Content-Type", content)]
        head += [(k, source[k]) for k in ("WARC-Warcinfo-ID", "WARC-IP-Address") if k in source]
        if "WARC-Payload-Digest" in source or payload:
            head.append(("WARC-Source-Payload-Digest", source.get("WARC-Payload-Digest") or digest(payload)))
        out.append({"record_id": own, "type": name, "uri": uri, "date": date, "headers": head, "block": body})
    return out


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of raw pages ``(page_id, url, html)``; null urls and pages are empty ones."""
    uri, body = text_of("url"), text_of("html").cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    key = F.sha2(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri), 256)
    own = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(key, 1, 8), F.substring(key, 9, 4), F.concat(F.lit("8"), F.substring(key, 14, 3)), F.concat(F.lit("8"), F.substring(key, 18, 3)), F.substring(key, 21, 12)), F.lit(">"))
    digest = F.struct(F.lit("WARC-Payload-Digest").alias("name"), F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("value"))
    info = F.struct(F.lit("WARC-Warcinfo-ID").alias("name"), F.lit(f"<urn:uuid:{uuid.uuid5(SPACE, date)}>").alias("value"))
    return pages.select("page_id", own.alias("record_id"), F.lit("response").alias("type"), uri.alias("uri"), F.lit(date).alias("date"), F.array(digest, info).alias("headers"), F.concat(head, body).alias("block"))


def derive(records: DataFrame, key: str | None = None) -> DataFrame:
    """Two records for each response of ``records``; other types have none.

    ``key`` names a column that is carried over. Null ids, targets and blocks are empty ones, and
    repeated responses are derived again. An empty table gives an empty result. Only ``key`` and the
    columns of a record are read and returned, so names of other columns can't clash.
    """
    short_batches(records.sparkSession)
    kept = f"{key} {records.schema[key].dataType.simpleString()}, " if key else ""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, r in enumerate(b.itertuples(index=False)):
                names = [] if r.headers is None else [(h["name"], h["value"]) for h in r.headers]
                for x in derived(r.record_id or "", r.uri or "", r.date or "", names, r.block or b""):
                    x["headers"] = [{"name": k, "value": v} for k, v in x["headers"]]
                    out.append(x | ({key: b[key].iloc[i]} if key else {}))
            if out:
                yield pd.DataFrame(out)

    records = records.select(*([key] if key else []), "record_id", "type", "uri", "date", "headers", "block")
    return records.where("type = 'response'").mapInPandas(of, kept + RECORD)


def serialized(record_id: str, kind: str, uri: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date)] + ([("WARC-Target-URI", uri)] if uri else [])
    lines = [VERSION] + [f"{k}: {' '.join(v.split())}" for k, v in head + headers if k.lower() != "content-length"] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: BinaryIO) -> Iterator[dict]:
    """The records of an uncompressed WARC stream, one at a time."""
    fixed = {"warc-type", "warc-record-id", "warc-date", "warc-target-uri", "content-length"}
    while version := data.readline():
        if not version.strip():
            continue
        lines = list(iter(lambda: data.readline().rstrip(b"\r\n"), b""))
        head = [(k, v.strip()) for k, _, v in (x.decode().partition(":") for x in lines)]
        own = {k.lower(): v for k, v in head}
        yield {"record_id": own["warc-record-id"], "type": own["warc-type"], "uri": own.get("warc-target-uri", ""), "date": own["warc-date"], "headers": [h for h in head if h[0].lower() not in fixed], "block": data.read(int(own["content-length"]))}


def write(records: DataFrame, folder: str) -> list[str]:
    """Writes one gzip file for each partition, a member for each record; returns the files' names."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def fill(out) -> None:
            for b in batches:
                for r in b.itertuples(index=False):
                    raw = serialized(r.record_id or "", r.type, r.uri or "", r.date or "", [(h["name"], h["value"]) for h in r.headers], r.block or b"")
                    out.write(gzip.compress(raw, 6, mtime=0))

        yield pd.DataFrame({"name": [_put(folder, f"derived-{TaskContext.get().partitionId():06d}.warc.gz", fill)]})

    return sorted(r.name for r in records.mapInPandas(of, "name string").collect())


def read(folder: str, name: str) -> Iterator[dict]:
    """The records of a written file; the file is read as they are asked for."""
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/{name}", compression=None) as f:
        yield from parsed(io.BufferedReader(gzip.GzipFile(fileobj=f)))
