"""WARC archives: a writer, and a sequential reader that checks what it reads.

Archives are sequences of gzip members, one for each record. They are written by
Spark's own file writer, so they go to any file system that Spark writes to, with
its commit protocol, and are read back file by file: members are inflated piece by
piece, records are framed by their content length, and digests are verified.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, HEAVY_SHARE, Scratch, prepare

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1000
#: Records in one archive file at most, and bytes of their pages: a file is read whole by one task.
FILE_RECORDS, FILE_BYTES = 400, 256 << 20
#: Classes of pages by bytes: of each, files have records of a like length. Longer ones than the last but one are alone or few in a file.
LENGTHS = (1 << 16, 1 << 20, 1 << 24, 1 << 31)
#: Bytes that are inflated at a time.
CHUNK = 1 << 16

#: A gzip member without content: 20 bytes, the last of them 0.
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)


class WarcError(ValueError):
    """An archive that is cut short or breaks the format."""


def member(data: bytes, level: int = 6) -> bytes:
    """data as one gzip member, the same on every run."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return deflate.compress(data) + deflate.flush()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {re.sub(r'[\x00-\x1f\x7f]', ' ', v)}".encode("utf-8", "surrogatepass") for k, v in headers]
    return b"\r\n".join([VERSION, *lines, f"Content-Length: {len(block)}".encode(), b"", block]) + b"\r\n\r\n"


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def page_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record of an HTTP answer with this payload, or a revisit without it.

    A revisit keeps the answer's headers, its Content-Length among them, and the
    payload's digest.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", date)]
    if url:
        headers.append(("WARC-Target-URI", url))
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))]
    return record(headers, block)


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def http(self) -> tuple[dict[str, str], bytes]:
        """The block's HTTP headers (names in lower case) and what follows them."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _fields(head.split(b"\r\n")[1:]), body


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"no field: {line[:80]!r}")
        out[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "surrogatepass")
    return out


def members(chunks: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a stream, the iterator of its inflated pieces; each is used up before the next."""
    source = iter(chunks)
    rest = b""

    def one() -> Iterator[bytes]:
        nonlocal rest
        inflate = zlib.decompressobj(16 + zlib.MAX_WBITS)
        while not inflate.eof:
            if not rest:
                rest = next(source, b"")
                if not rest:
                    raise WarcError("the archive ends within a gzip member")
            try:
                piece = inflate.decompress(rest, CHUNK)
            except zlib.error as e:
                raise WarcError(f"no gzip member: {e}") from e
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if piece:
                yield piece

    while True:
        if not rest:
            rest = next(source, b"")
            if not rest:
                return
        pieces = one()
        yield pieces
        for _ in pieces:
            pass


def read(chunks: Iterable[bytes]) -> Iterator[Record]:
    """The records of an archive in order. Raises WarcError where it is cut short, wrongly framed or altered."""
    for pieces in members(chunks):
        data = bytearray()
        end = -1
        for piece in pieces:
            data += piece
            end = data.find(b"\r\n\r\n", max(0, len(data) - len(piece) - 3))
            if end >= 0:
                break
        if not data:
            continue
        if end < 0:
            raise WarcError("a record without an end of its headers")
        lines = bytes(data[:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise WarcError(f"no record: {lines[0][:40]!r}")
        headers = _fields(lines[1:])
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("a record without a content length") from e
        del data[: end + 4]
        for piece in pieces:
            data += piece
        if size < 0 or bytes(data[size:]) != b"\r\n\r\n":
            raise WarcError(f"a record's block has {len(data) - 4} bytes, not {size}")
        out = Record(headers, bytes(data[:size]))
        _verify(out)
        yield out


def _verify(r: Record) -> None:
    for name, held in (("warc-block-digest", r.block), ("warc-payload-digest", None)):
        if name not in r.headers or (held is None and r.headers.get("warc-type") == "revisit"):
            continue
        if held is None:
            held = r.http()[1] if r.headers.get("content-type", "").startswith("application/http") else r.block
        if digest(held).lower() != r.headers[name].lower():
            raise WarcError(f"{name} of {r.headers.get('warc-record-id')} does not fit")


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the page whose response an equal payload revisits, else null.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id
    is stored (all rows with that id, if it repeats; all, if every id is null).
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = pages.withColumn("__sha1", F.sha1("html")).withColumn("__n", F.octet_length("html"))
    first = keyed.where(F.col("__n") >= least).groupBy("__sha1", "__n").agg(F.max("page_id").alias("__first"), F.count("*").alias("__k"))
    first = Scratch(pages.sparkSession, "revisits").save(first.where("__k > 1"), "first")
    on = ["__sha1", "__n"]
    if first.count() <= BROADCAST_IDS:
        out = keyed.join(F.broadcast(first), on, "left")
    else:  # payloads of many copies meet their page by broadcast; the others are few rows each
        most = (first.agg(F.sum("__k")).first()[0] or 0) // HEAVY_SHARE
        out = keyed.join(F.broadcast(first.where(F.col("__k") > most)), on, "left")
        rest = out.where("__k is null").drop("__first", "__k").join(first.where(F.col("__k") <= most), on, "left")
        out = out.where("__k is not null").unionByName(rest)
    return out.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first")).alias("refers_to"))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """Write pages (page_id, url, html, refers_to) as archives of at most file_records records into the folder path.

    Pages are written by classes of their length, and a class's files take as many records as file_bytes hold of its
    longest page. So one very long page makes no small files of the others. Classes are few, and those without a page
    are not written.

    Spark's text writer puts one byte after each row. A gzip member ends with its
    size's highest byte, 0 below 16 MB; that byte is taken off the row, and the
    writer's separator, byte 0, stands in its place. Longer members are followed by
    an empty one, which has no record.
    """
    prepare(pages.sparkSession)
    bytes_ = F.coalesce(F.octet_length("html"), F.lit(0))
    upto = F.lit(LENGTHS[-1])
    for most in reversed(LENGTHS[:-1]):
        upto = F.when(bytes_ <= most, most).otherwise(upto)
    classes = {r.upto: r.longest for r in pages.groupBy(upto.alias("upto")).agg(F.max(bytes_).alias("longest")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, html, ref in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                data = member(page_record(page.as_py(), url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), ref.as_py(), date))
                if data[-1]:
                    data += _EMPTY_MEMBER
                rows.append(data[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    for k, (most, longest) in enumerate(sorted(classes.items()) or [(LENGTHS[0], 0)]):
        held = pages.where(upto == most) if len(classes) > 1 else pages
        out = held.select("page_id", "url", "html", "refers_to").mapInArrow(run, "value binary")
        records = max(1, min(file_records, file_bytes // (longest + 1024)))
        out.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\u0000").option("maxRecordsPerFile", records).mode("append" if k else "errorifexists").text(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder: file, record (from 0), type, id, uri, refers_to, payload_digest
    (lower-case hex), payload_bytes, payload (null for a revisit).

    A broken archive fails the job; an empty folder gives no rows.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path", "content")
    schema = "file string, record bigint, type string, id string, uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                view = memoryview(content.as_buffer())
                pieces = (bytes(view[i : i + CHUNK]) for i in range(0, len(view), CHUNK))
                rows: list[tuple] = []
                size = 0
                for k, r in enumerate(read(pieces)):
                    h = r.headers
                    http, body = r.http() if h.get("content-type", "").startswith("application/http") else ({}, r.block)
                    revisit = h.get("warc-type") == "revisit"
                    said = h.get("warc-payload-digest", "")
                    sha1 = base64.b32decode(said[5:].upper()).hex() if said.lower().startswith("sha1:") else hashlib.sha1(body).hexdigest()
                    n = int(http.get("content-length", 0)) if revisit else len(body)
                    rows.append((name.as_py(), k, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), sha1, n, None if revisit else body))
                    size += len(body)
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["file", "record", "type", "id", "uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
