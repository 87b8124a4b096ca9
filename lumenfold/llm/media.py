"""Media columns: documents as ordered sequences of text and media.

HTML is parsed into one array for each document: text blocks and media
references in the order in which they stand, each with its position and, for
media, its caption. References are digests; a join by digest brings the stored
payloads, or what was computed from them, to every place that refers to them.
Payloads are stored once for each task that meets them, as 8-bit greyscale PNG.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, prepare

WIDTH = 64
LEVEL = 1
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title".split())
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source"}
_HIDDEN = frozenset(("script", "style", "template", "noscript"))


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, with zeros up to a positive multiple of WIDTH, and how many they were."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)


def encode_png(payload: bytes) -> bytes:
    """payload (whole rows of WIDTH bytes) as the samples of a greyscale PNG; equal payloads, equal files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter, 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    parts = ((b"IHDR", header), (b"IDAT", zlib.compress(lines.tobytes(), LEVEL)), (b"IEND", b""))
    return _SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def decode_png(stored: bytes) -> tuple[np.ndarray, int, int]:
    """The samples of such a PNG as (height, width), with every chunk's checksum verified."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, header = 8, [], None
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG")
    width, height = header[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that this reader does not know")
    return lines[:, 1:], width, height


def features(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy (bits) and mean step along rows of the samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    p = counts / counts.sum()
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, p @ np.arange(256) ** 2 - mean * mean)))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum()) + 0.0
    step = int(np.abs(np.diff(samples.astype(np.int16), axis=1)).sum(dtype=np.int64)) / samples.size
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} deviation={deviation:.4f} entropy={entropy:.4f} step={step:.4f}"


class _Interleaver(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figures: list[tuple[list[int], list[str]]] = []  # media and caption of each open figure
        self.captions: list[list[str]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self._add("text", text, None, None)

    def _add(self, kind: str, text: str | None, src: str | None, caption: str | None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "src": src, "caption": caption})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append(([], []))
        elif tag == "figcaption":
            self.captions.append([])
        elif tag in _MEDIA and not self.hidden:
            said = dict(attrs)
            if said.get("src"):
                self.flush()
                if self.figures:
                    self.figures[-1][0].append(len(self.items))
                self._add(_MEDIA[tag], None, said["src"], said.get("alt") or said.get("title"))

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in _BLOCKS:
            self.flush()
        if tag == "figcaption" and self.captions:
            caption = " ".join("".join(self.captions.pop()).split())
            if self.figures:
                self.figures[-1][1].append(caption)
            elif caption:
                self._add("text", caption, None, None)
        elif tag == "figure" and self.figures:
            media, captions = self.figures.pop()
            caption = " ".join(c for c in captions if c)
            if caption and not media:
                self._add("text", caption, None, None)
            for k in media if caption else ():
                self.items[k]["caption"] = caption

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        (self.captions[-1] if self.captions else self.text).append(data)


def interleave(html: str | None) -> list[dict]:
    """Text blocks and media of a page in order: position, kind, text, src, caption.

    Scripts and styles are left out, white space is collapsed. A figure's caption
    goes to the media in the figure (also if it stands before them), else the
    media's alt or title text. Broken HTML is read as far as it goes; null is empty.
    """
    p = _Interleaver()
    p.feed(html or "")
    p.close()
    p.flush()
    while p.captions or p.figures:  # left open at the end
        p.handle_endtag("figcaption" if p.captions else "figure")
    return p.items


SEQUENCE = "array<struct<position:bigint,kind:string,text:string,src:string,caption:string>>"


def sequences(pages: DataFrame) -> DataFrame:
    """pages with their html replaced by the column sequence, the ordered items of interleave()."""
    prepare(pages.sparkSession)
    kept = [c for c in pages.columns if c not in ("html", "sequence")]
    kind = pa.list_(pa.struct([("position", pa.int64()), *((c, pa.string()) for c in ("kind", "text", "src", "caption"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [interleave(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got, kind)], names=[*kept, "sequence"])

    schema = pages.select(*kept, F.lit(None).cast(SEQUENCE).alias("sequence")).schema
    return pages.select(*kept, "html").mapInArrow(run, schema)


def resolve(pages: DataFrame, media: DataFrame) -> DataFrame:
    """One row for each media item of pages' sequences, with media's columns where its digest is known.

    pages: sequence and other columns. media: digest (distinct; hex SHA-256) and
    other columns, null where a reference has no payload. References are the sources
    of the form ``sha256:<hex>``; others stay unresolved. Adds position, kind,
    src and caption, so that items stay where and as they were. Columns of pages that have
    the name of an added column or of one of media's are replaced; so are media's columns
    of the four names. A null or empty sequence gives no row.
    """
    added = ["position", "kind", "src", "caption"]
    brought = [c for c in media.columns if c not in added]
    carried = [c for c in pages.columns if c not in ("sequence", *added, *brought)]
    item, own = fresh(pages.columns, "item"), fresh(media.columns, "source")
    items = pages.select(*carried, F.explode("sequence").alias(item)).where(f"{item}.kind <> 'text'")
    items = items.select(*carried, *(F.col(f"{item}.{c}").alias(c) for c in added))
    media = media.select(*brought, F.concat(F.lit("sha256:"), "digest").alias(own))
    return items.join(media, items["src"] == media[own], "left").select("src", *carried, *added[:2], "caption", *brought)


def store(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Texts of docs (doc_id, text) stored as media.

    Returns pages (doc_id, n_bytes, html that refers to the payload) and media
    (digest, media: PNG bytes; a digest may repeat), both saved. Null text is empty;
    repeated rows refer to the same payload.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of this task's payloads: 16 bytes each
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                payload, n = padded(text.as_py())
                digest = hashlib.sha256(payload).digest()
                stored = None if digest[:16] in seen else encode_png(payload)
                seen.add(digest[:16])
                name = f"{n} bytes"
                html = f'<figure><img src="sha256:{digest.hex()}" width="{WIDTH}" height="{len(payload) // WIDTH}"><figcaption>{escape(name)}</figcaption></figure>'
                rows.append((doc, n, html, digest.hex(), stored))
                size += len(stored or b"")
                if size > 8 << 20:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "html", "digest", "media"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    saved = scratch.save(docs.mapInArrow(run, "doc_id bigint, n_bytes bigint, html string, digest string, media binary"), "media")
    return saved.select("doc_id", "n_bytes", "html"), saved.where("media is not null").select("digest", "media")


def describe(media: DataFrame) -> DataFrame:
    """What the stored media hold, read back: digest (distinct), payload_bytes, payload_sha256, tail_crc32
    (of the last WIDTH bytes), media_bytes, media_sha256, feature.

    A file that is damaged or whose samples do not have the digest fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                stored = stored.as_py()
                samples, _, _ = decode_png(stored)
                payload = samples.tobytes()
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest:
                    raise ValueError(f"stored media do not have their digest {digest}")
                rows.append((digest, len(payload), sha, zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples)))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    schema = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.mapInArrow(run, schema).dropDuplicates(["digest"])
