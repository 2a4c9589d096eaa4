"""Media columns: documents as ordered sequences of text and media references, with payloads joined by digest.

A document's HTML is parsed into parts in page order: runs of text, and media references with the address, digest, size and
caption that the page gives them. Payloads live once in a media table keyed by digest; ``sha256:`` addresses name their digest, other
addresses find theirs in a table of addresses. ``resolve`` joins by digest; every reference keeps its place and its own caption,
however often a payload is used.

Payloads are stored as 8-bit grey PNG images of width 64: lossless, readable by any image library, and each sample is one
byte of the payload.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import slices, stash

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of ``unit``."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a PNG of 64 samples a row."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each row begins with its filter type, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def decode(image: bytes) -> bytes:
    """The samples of an image that ``encode`` has made. ValueError if it is damaged."""
    if not image.startswith(_SIGNATURE):
        raise ValueError("not a PNG image")
    at, head, parts = len(_SIGNATURE), None, []
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + data)) != image[at + 8 + size : at + 12 + size]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    if head is None or head[0] != WIDTH or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of image")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(head[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("another row filter")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, sum, extremes, distinct values and an eight-bin histogram of the samples."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    present = np.flatnonzero(counts)
    total = int((counts * np.arange(256)).sum())
    bins = ",".join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))
    return f"rows={len(payload) // WIDTH};sum={total};min={present[0]};max={present[-1]};distinct={len(present)};hist={bins}"


PARTS = "array<struct<position:int,kind:string,text:string,url:string,digest:string,n_bytes:bigint>>"

#: Elements in front of and behind which a run of text ends.
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_MEDIA = frozenset("img audio video source embed".split())
_SILENT = frozenset("script style template".split())


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.figures: list[tuple[list[dict], list[str]]] = []  # of each open figure its media and its caption
        self.in_caption = 0
        self.silent = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.parts.append({"kind": "text", "text": text, "url": None, "digest": None, "n_bytes": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SILENT:
            self.silent += 1
        elif tag in _MEDIA:
            own: dict[str, str] = {}
            for k, v in attrs:
                own.setdefault(k, v or "")
            url = own.get("src", "").strip() or own.get("srcset", "").strip().split(" ")[0].rstrip(",")
            if url and not self.silent:
                if not self.in_caption:
                    self.flush()
                size = own.get("data-bytes", "").strip()
                digest = url.removeprefix("sha256:") if url.startswith("sha256:") else None
                part = {"kind": "media", "text": " ".join(own.get("alt", "").split()) or None, "url": url, "digest": digest, "n_bytes": int(size) if size.isascii() and size.isdigit() and len(size) < 19 else None}
                self.parts.append(part)
                if self.figures:
                    self.figures[-1][0].append(part)
        elif tag in _BLOCKS:
            if self.in_caption:
                self.figures[-1][1].append(" ")
            else:
                self.flush()
            if tag == "figure":
                self.figures.append(([], []))
                self.in_caption = 0
            elif tag == "figcaption" and self.figures:
                self.in_caption = 1

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.in_caption = 0
        elif tag == "figure" and self.figures:
            self.in_caption = 0
            self.flush()
            self._caption()
        elif tag in _BLOCKS:
            if self.in_caption:
                self.figures[-1][1].append(" ")
            else:
                self.flush()

    def _caption(self) -> None:
        """The innermost figure ends: its caption, if it has one, is that of all its media."""
        media, words = self.figures.pop()
        caption = " ".join("".join(words).split())
        for part in media if caption else ():
            part["text"] = caption

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.figures[-1][1] if self.in_caption else self.text).append(data)

    def finish(self) -> None:
        self.flush()
        while self.figures:  # figures that the page doesn't close
            self._caption()


def sequence(page: str | None) -> list[dict]:
    """The page's parts in order: position, kind (text or media), text (or caption), url, digest and n_bytes.

    Runs of text end at block elements, line breaks and media. A medium's caption is that of its innermost figure, or else
    its alternative text. Media without an address, and sizes that are no numbers, are passed over.
    """
    reader = _Sequence()
    reader.feed(page or "")
    reader.close()
    reader.finish()
    return [{"position": k, **x} for k, x in enumerate(reader.parts)]


_PARTS_TYPE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64())]))


def sequences(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """Per page: id and ``parts``. A null or empty page has none; the other columns are ignored."""
    rows = pages.select(F.col(id_col), F.col(html_col).alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sequence(x) for x in part.column(1).to_pylist()], _PARTS_TYPE)], names=[id_col, "parts"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, parts {PARTS}")


def resolve(pages: DataFrame, media: DataFrame, id_col: str, addresses: DataFrame | None = None) -> DataFrame:
    """One row per media reference: id, position, caption, url, n_bytes, digest and the columns of ``media`` (nulls if it lacks
    the digest). ``media`` has one row per digest; ``addresses`` (url, digest), with one row per url, gives the digests of
    ordinary addresses. References may favour one digest; the joins are plain ones, whose large partitions adaptive execution
    splits."""
    refs = pages.select(F.col(id_col), F.explode("parts").alias("__p")).where("__p.kind = 'media'")
    refs = refs.select(id_col, F.col("__p.position").alias("position"), F.col("__p.text").alias("caption"), F.col("__p.url").alias("url"), F.col("__p.n_bytes").alias("n_bytes"), F.col("__p.digest").alias("digest"))
    if addresses is not None:
        known = addresses.select(F.col("url").alias("__url"), F.col("digest").alias("__digest"))
        refs = refs.join(known, F.col("digest").isNull() & (F.col("url") == F.col("__url")), "left").withColumn("digest", F.coalesce("digest", "__digest")).drop("__url", "__digest")
    return refs.join(media, "digest", "left")


def illustrated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a page with one figure: id, html, digest, media (the stored form of the padded UTF-8 text)."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                pages, digests, images = [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    payload = pad(data)
                    digest = hashlib.sha256(payload).hexdigest()
                    name = html.escape(str(i))
                    pages.append(f'<article><p>Document {name}</p><figure><img src="sha256:{digest}" data-bytes="{len(data)}"><figcaption>Text of {name}</figcaption></figure></article>')
                    digests.append(digest)
                    images.append(encode(payload))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(images, pa.binary())], names=[id_col, "html", "digest", "media"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, html string, digest string, media binary")


def described(media: DataFrame) -> DataFrame:
    """Read stored media (digest, media) back: digest, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256 and feature. A payload that doesn't have its digest raises ValueError."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for digest, image in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    image = image.as_py()
                    payload = decode(image)
                    own = hashlib.sha256(payload).hexdigest()
                    if own != digest:
                        raise ValueError(f"payload {digest} is damaged")
                    rows.append((digest, len(payload), own, zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_DESCRIBED)

    return media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


_DESCRIBED = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_of_texts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Store every text as media, read the media back and join what they say to the documents that refer to them.

    A null or empty text is a payload of 64 zero bytes with n_bytes 0. Equal texts share a digest and get equal
    values; repeated rows are kept; long texts are stored whole; extra columns are ignored; an empty table
    gives an empty result.
    """
    held = stash(illustrated(docs, id_col), "media")
    facts = stash(described(held).dropDuplicates(["digest"]), "media-facts")
    out = resolve(sequences(held, id_col), facts, id_col)
    return out.select(id_col, "n_bytes", *_DESCRIBED[1:])
