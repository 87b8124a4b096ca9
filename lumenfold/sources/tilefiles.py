"""Tile artifacts as binary blobs: a header, one record for each frame, the mask bytes; compressed with gzip.

Layout, little endian: 4 bytes of magic, uint16 version, uint32 frames, uint32 points; for each frame
int32 minute, float64 altitude, uint32 length of its mask; then the masks in order.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAGIC, VERSION = b"LFTA", 1
_HEAD, _FRAME = struct.Struct("<4sHII"), struct.Struct("<idI")
FRAMES = "array<struct<minute:int,altitude:double,mask:binary>>"
_FRAMES = pa.list_(pa.struct([("minute", pa.int32()), ("altitude", pa.float64()), ("mask", pa.binary())]))


def encode(points: int, frames: list[dict]) -> bytes:
    head = [_HEAD.pack(MAGIC, VERSION, len(frames), points), *(_FRAME.pack(f["minute"], f["altitude"], len(f["mask"])) for f in frames)]
    return gzip.compress(b"".join([*head, *(f["mask"] for f in frames)]), 6, mtime=0)


def decode(blob: bytes) -> tuple[int, list[dict]]:
    """points and frames. ValueError where the blob is not a whole artifact of this version."""
    raw = gzip.decompress(blob)
    if len(raw) < _HEAD.size or raw[:4] != MAGIC:
        raise ValueError("not a tile artifact")
    _, version, n, points = _HEAD.unpack_from(raw)
    at = _HEAD.size + n * _FRAME.size
    if version != VERSION or at > len(raw):
        raise ValueError("a tile artifact of another version, or cut short")
    frames = []
    for k in range(n):
        minute, altitude, size = _FRAME.unpack_from(raw, _HEAD.size + k * _FRAME.size)
        frames.append({"minute": minute, "altitude": altitude, "mask": raw[at : at + size]})
        at += size
    if at != len(raw):
        raise ValueError("a tile artifact whose masks do not fill it")
    return points, frames


def encoded(tiles: DataFrame, key: str) -> DataFrame:
    """tiles (key, points, frames) as key, artifact."""
    kind = tiles.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [encode(p, f) for p, f in zip(b.column("points").to_pylist(), b.column("frames").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(blobs, pa.binary())], names=[key, "artifact"])

    return tiles.select(key, "points", "frames").mapInArrow(run, f"{key} {kind}, artifact binary")


def decoded(artifacts: DataFrame, key: str) -> DataFrame:
    """key, points, frames of artifacts (key, artifact). A damaged one fails the job."""
    kind = artifacts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decode(x) for x in b.column("artifact").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([p for p, _ in got], pa.int32()), pa.array([f for _, f in got], _FRAMES)], names=[key, "points", "frames"])

    return artifacts.select(key, "artifact").mapInArrow(run, f"{key} {kind}, points int, frames {FRAMES}")
