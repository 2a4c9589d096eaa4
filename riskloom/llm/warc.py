"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Pages become ``response`` records whose HTTP body has chunked transfer framing; a block longer than ``segment``
bytes goes on in ``continuation`` records, which stand in another archive of the same batch. Pages that repeat a payload
become ``revisit`` records. Every record is a gzip member of its own. An archive is kept as one binary value
of a Parquet row, so that any store that Spark reaches can hold it and no row is larger than a batch.

Reading parses all archives. Records without segments are decoded where they are found; segments are grouped by the identifier of
their origin, put in order of their number, held against the total length, joined and decoded. Damage costs no other record: what
can't be parsed, and continuations whose origin is lost, are rows of their own that say so.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import attach

CRLF = b"\r\n"
_ID = "urn:riskloom:page:"
#: How a gzip member begins: magic number and method.
_MEMBER = b"\x1f\x8b\x08"


@dataclass(frozen=True)
class Layout:
    """segment: bytes of a block in one record; chunk: bytes of a transfer chunk; least: shorter payloads never
    revisit; batch: payload bytes of one batch of archives; date: of all records."""

    segment: int = 16 << 10
    chunk: int = 4 << 10
    least: int = 100
    batch: int = 2 << 20
    date: str = "2024-01-01T00:00:00Z"


def chunked(body: bytes, size: int) -> bytes:
    """The body in chunked transfer framing."""
    parts = []
    for k in range(0, len(body), size):
        piece = body[k : k + size]
        parts += (b"%x" % len(piece), CRLF, piece, CRLF)
    return b"".join([*parts, b"0", CRLF, CRLF])


def dechunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; extensions and trailers are passed over. ValueError if it is cut short, also
    where only the empty line that ends it is missing."""
    parts, at = [], 0
    while True:
        end = framed.find(CRLF, at)
        if end < 0:
            raise ValueError("a chunk has no size")
        digits = framed[at:end].split(b";")[0].strip()
        if not digits or digits.translate(None, b"0123456789abcdefABCDEF"):
            raise ValueError("a chunk's size is no number")
        size = int(digits, 16)
        if size == 0:
            if framed[end : end + 4] != CRLF + CRLF and framed.find(CRLF + CRLF, end + 2) < 0:
                raise ValueError("the last chunk is cut short")
            return b"".join(parts)
        at = end + 2
        if framed[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk is cut short")
        parts.append(framed[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1" + CRLF + head.encode("utf-8") + CRLF + block + CRLF + CRLF


def member(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(archive: bytes, window: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an archive, unpacked one by one. ValueError at the first that is damaged or cut short."""
    for data in salvaged(archive, window):
        if data is None:
            raise ValueError("a member is damaged or cut short")
        yield data


def salvaged(archive: bytes, window: int = 1 << 16) -> Iterator[bytes | None]:
    """The gzip members of an archive, and None for each stretch of damage, after which the next member is looked for."""
    view, at = memoryview(archive), 0
    while at < len(view):
        z, parts, begin = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                if at >= len(view):
                    raise zlib.error("cut short")
                parts.append(z.decompress(view[at : at + window]))
                at = min(at + window, len(view)) - len(z.unused_data)
        except zlib.error:
            yield None
            at = archive.find(_MEMBER, begin + 1)
            if at < 0:
                return
            continue
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(CRLF + CRLF)
    version, *fields = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise ValueError("a header is missing")
    size = _whole_number(headers.get("content-length"))
    if len(rest) != size + 4:
        raise ValueError("the record's length is wrong")
    return headers, rest[:size]


def _whole_number(text: str | None) -> int:
    if not text or not text.isascii() or not text.isdigit() or len(text) > 18:
        raise ValueError(f"not a whole number: {text!r}")
    return int(text)


def http(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and body, the transfer framing taken off."""
    head, _, body = block.partition(CRLF + CRLF)
    headers = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in head.decode("utf-8").split("\r\n")[1:])}
    return headers, dechunked(body) if headers.get("transfer-encoding") == "chunked" else body


def _uri(url: str | None) -> str:
    return re.sub(r"[\s<>]", lambda m: "%%%02X" % ord(m.group()), url or "") or "about:blank"


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, layout: Layout) -> list[bytes]:
    """The page's records: one revisit, or one response and its continuations. first: the page it revisits."""
    own = f"<{_ID}{'' if page_id is None else page_id}>"
    common = [("WARC-Date", layout.date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if first is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_ID}{first}>"), ("Content-Type", "application/http;msgtype=response")], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, layout.chunk)
    pieces = [block[k : k + layout.segment] for k in range(0, len(block), layout.segment)]
    head = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(pieces) == 1:
        return [record(head, block)]
    out = [record([*head, ("WARC-Segment-Number", "1")], pieces[0])]
    for n, piece in enumerate(pieces[1:], start=2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{n}>"), ("WARC-Date", layout.date), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        if n == len(pieces):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(more, piece))
    return out


_ARCHIVE = pa.schema([("batch", pa.string()), ("archive", pa.string()), ("data", pa.binary())])


def write_archives(pages: DataFrame, layout: Layout = Layout(), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows (batch, archive, data): the archives of all pages. A page that repeats an earlier page's payload of ``least``
    bytes or more, earlier by id, is a revisit of the earliest one.

    A null html is an empty payload and a null url ``about:blank``. Pages without an id are responses; rows that repeat an id are
    written each, into batches of their own. Long pages are written whole, in as many segments as they need; other columns are
    ignored; an empty table gives no archive.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    rows = rows.withColumn("__group", F.when((F.octet_length("html") >= layout.least) & F.col("page_id").isNotNull(), F.col("digest")))
    rows = attach(rows, "__group", "page_id", {"first": (F.col("page_id"), "min")}).select("page_id", "url", "html", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("first"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{number:06d}"
            info = member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:riskloom:archive:{name}>"), ("WARC-Date", layout.date), ("Content-Type", "application/warc-fields")], b"software: riskloom\r\nformat: WARC File Format 1.1\r\n"))
            files = [(k, b"".join([info, *held])) for k, held in (("a", main), ("b", rest)) if held]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(files)), pa.array([f"{name}-{k}.warc.gz" for k, _ in files]), pa.array([d for _, d in files], pa.binary())], schema=_ARCHIVE)

        part, number = TaskContext.get().partitionId(), 0
        main, rest, seen, size = [], [], set(), 0
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= layout.batch or page_id in seen:  # an id stands for one page of a batch
                    yield flush()
                    number, main, rest, seen, size = number + 1, [], [], set(), 0
                payload = html.encode("utf-8", "surrogatepass")
                head, *more = page_records(page_id, url, payload, digest, first, layout)
                main.append(member(head))
                rest += map(member, more)
                seen.add(page_id)
                size += len(payload)
        if main:
            yield flush()

    return rows.mapInArrow(run, "batch string, archive string, data binary")


_RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, segments int, complete boolean"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(_ID)
    return int(digits) if digits.removeprefix("-").isdigit() and digits.isascii() and len(digits) < 20 else None


def _decoded(headers: dict[str, str], block: bytes, segments: int, whole: bool = True) -> tuple:
    """One result row; complete says whether all segments, the framing and the payload's digest are right."""
    stated = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = headers["warc-type"]
    try:
        fields, payload = http(block) if whole else ({}, b"")
    except ValueError:
        fields, payload, whole = {}, b"", False
    if kind == "revisit":
        length = fields.get("content-length", "")
        size, digest = int(length) if length.isascii() and length.isdigit() else 0, stated
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        whole = whole and digest == stated
    return (_number(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest, kind, _number(headers.get("warc-refers-to")), segments, whole)


def _records(archives: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Batch, headers and block of every record; a damaged one has the type ``damaged``."""
    for rows in archives:
        for batch, data in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            for raw in salvaged(data.as_py() or b""):
                try:
                    if raw is None:
                        raise ValueError("a member is damaged")
                    headers, block = parse(raw)
                    if "warc-segment-number" in headers:
                        _whole_number(headers["warc-segment-number"])
                        _whole_number(headers.get("warc-segment-total-length", "0"))
                except ValueError:
                    headers, block = {"warc-type": "damaged", "warc-record-id": ""}, b""
                if headers["warc-type"] in ("response", "revisit", "continuation", "damaged"):
                    yield batch, headers, block


def _join(rows: pd.DataFrame) -> pd.DataFrame:
    """The segments of one origin: in order, without gap, of the stated total length. Continuations alone give a row of
    type ``continuation`` with the page's id."""
    rows = rows.sort_values("number", kind="stable")
    block = b"".join(rows["block"])
    whole = rows["number"].tolist() == list(range(1, len(rows) + 1)) and rows["total"].max() == len(block)
    firsts = [h for h in rows["headers"] if h]
    if firsts:
        headers = dict(x.split(": ", 1) for x in firsts[0].split("\n") if ": " in x)
        found = _decoded(headers, block, len(rows), bool(whole))
    else:
        found = (_number(rows["origin"].iat[0].partition(" ")[2]), None, 0, None, "continuation", None, len(rows), False)
    return pd.DataFrame([found], columns=_NAMES).astype({"refers_to": "Int64", "page_id": "Int64"})


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per page: page_id, url, payload_bytes, payload_digest, record_type, refers_to, segments, complete.

    complete is false where segments, framing or digest are not right. A record that can't be parsed is a row of type ``damaged``
    without an id, and continuations without their origin are one row of type ``continuation``; both are not complete. No archive, no row.
    """

    def single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_decoded(h, block, 1) if h["warc-type"] != "damaged" else (None, None, 0, None, "damaged", None, 0, False) for _, h, block in _records([batch]) if "warc-segment-number" not in h]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names=_NAMES)

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (f"{b} {h.get('warc-segment-origin-id') or h['warc-record-id']}", int(h["warc-segment-number"]), int(h.get("warc-segment-total-length", 0)), "\n".join(f"{k}: {v}" for k, v in h.items()) if h["warc-type"] == "response" else "", block)
                for b, h, block in _records([batch])
                if "warc-segment-number" in h
            ]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names=["origin", "number", "total", "headers", "block"])

    files = archives.select("batch", "data")
    whole = files.mapInArrow(single, _RESULT)
    parts = files.mapInArrow(segments, "origin string, number int, total long, headers string, block binary")
    return whole.unionByName(parts.groupBy("origin").applyInPandas(_join, _RESULT))
