"""Raster files in the tagged image format with a place on the map, as a data source of Spark, and their writer.

The source reads a file's directory, makes partitions of its blocks (tiles or strips) and passes over the
blocks that a filter on x and y rules out; tasks read and unpack only their own blocks. One band of whole or
floating numbers; plain, deflated or LZW blocks; both predictors; classic and large files of either byte order.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

# Numbers of tags and codes of the format. (Fixed values.)
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
CELL_SIZE, TIE_POINT, NO_DATA = 33550, 33922, 42113
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}

CELLS = "tile string, rx int, ry int, x double, y double, value double"
FILES = "tile string, min_x double, min_y double, max_x double, max_y double, width int, height int"


class RasterError(ValueError):
    """A file that is no raster of the kinds read here."""


def opened(path: str):
    """A file of any file system that Arrow knows, to be read in pieces."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


@dataclass(frozen=True)
class Image:
    """The first directory of a file."""

    path: str
    order: str
    tags: dict

    @classmethod
    def read(cls, path: str) -> Image:
        with opened(path) as f:
            head = f.read_at(16, 0)
            if len(head) < 8 or head[:2] not in (b"II", b"MM"):
                raise RasterError(f"{path}: no tagged image")
            order = "<" if head[:2] == b"II" else ">"
            version = struct.unpack(order + "H", head[2:4])[0]
            if version not in (42, 43):
                raise RasterError(f"{path}: version {version}")
            large = version == 43
            at = struct.unpack(order + "Q", head[8:16])[0] if large else struct.unpack(order + "I", head[4:8])[0]
            count, wide, entry = ("Q", 8, 20) if large else ("H", 2, 12)
            n = struct.unpack(order + count, f.read_at(wide, at))[0]
            rows, tags = f.read_at(n * entry, at + wide), {}
            for k in range(n):
                tag, kind, size = struct.unpack(order + ("HHQ" if large else "HHI"), rows[k * entry : k * entry + (12 if large else 8)])
                if kind not in _TYPES:
                    continue
                size_, room = size * struct.calcsize("=" + _TYPES[kind]), 8 if large else 4
                field = rows[(k + 1) * entry - room : (k + 1) * entry]
                raw = field[:size_] if size_ <= room else f.read_at(size_, struct.unpack(order + ("Q" if large else "I"), field)[0])
                tags[tag] = raw.split(b"\0")[0].decode("latin1") if kind == 2 else struct.unpack(f"{order}{size}{_TYPES[kind]}", raw)
        image = cls(path, order, tags)
        if image.one(BANDS, 1) != 1 or CELL_SIZE not in tags or TIE_POINT not in tags:
            raise RasterError(f"{path}: not one band with a place on the map")
        if image.one(COMPRESSION, PLAIN) not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE) or image.one(PREDICTOR, 1) not in (1, 2, 3):
            raise RasterError(f"{path}: compression {image.one(COMPRESSION, PLAIN)}, predictor {image.one(PREDICTOR, 1)}")
        return image

    def one(self, tag: int, default: int | None = None) -> int:
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def name(self) -> str:
        return os.path.splitext(os.path.basename(self.path))[0]

    @property
    def shape(self) -> tuple[int, int]:
        return self.one(HEIGHT), self.one(WIDTH)

    @property
    def block(self) -> tuple[int, int]:
        """Rows and columns of a block."""
        if TILES in self.tags:
            return self.one(TILE_HEIGHT), self.one(TILE_WIDTH)
        return min(self.one(STRIP_ROWS, self.shape[0]), self.shape[0]), self.shape[1]

    @property
    def blocks(self) -> int:
        return len(self.tags[TILES if TILES in self.tags else STRIPS])

    def edges(self, column: np.ndarray | float, row: np.ndarray | float) -> tuple:
        """x and y of a place given in columns and rows from the upper left corner."""
        (sx, sy), (i, j, _, x, y) = self.tags[CELL_SIZE][:2], self.tags[TIE_POINT][:5]
        return x + (column - i) * sx, y - (row - j) * sy

    def corner(self, k: int) -> tuple[int, int]:
        """First row and column of a block."""
        h, w = self.block
        across = -(-self.shape[1] // w)
        return k // across * h, k % across * w

    def box(self, k: int) -> tuple[float, float, float, float]:
        """min_x, min_y, max_x, max_y of the centres of a block's cells."""
        row, column = self.corner(k)
        bottom, right = min(row + self.block[0], self.shape[0]), min(column + self.block[1], self.shape[1])
        x0, y1 = self.edges(column + 0.5, row + 0.5)
        x1, y0 = self.edges(right - 0.5, bottom - 0.5)
        return x0, y0, x1, y1

    def values(self, f, k: int) -> np.ndarray:
        """The numbers of a block, without what fills it up beyond the image's edge; nan where there is no data."""
        at, size = (self.tags[t][k] for t in ((TILES, TILE_BYTES) if TILES in self.tags else (STRIPS, STRIP_BYTES)))
        raw, how = f.read_at(size, at), self.one(COMPRESSION, PLAIN)
        raw = zlib.decompress(raw) if how in (DEFLATE, OLD_DEFLATE) else unpack_lzw(raw) if how == LZW else raw
        kind = np.dtype(f"{self.order}{'uif'[self.one(FORMAT, 1) - 1]}{self.one(BITS) // 8}")
        (row, column), (h, w) = self.corner(k), self.block
        if TILES not in self.tags:
            h = min(h, self.shape[0] - row)
        if self.one(PREDICTOR, 1) == 3:
            planes = np.cumsum(np.frombuffer(raw, np.uint8, h * w * kind.itemsize).reshape(h, -1), axis=1, dtype=np.uint8)
            block = planes.reshape(h, kind.itemsize, w).transpose(0, 2, 1).copy().view(kind.newbyteorder(">"))[:, :, 0]
        else:
            block = np.frombuffer(raw, kind, h * w).reshape(h, w)
            if self.one(PREDICTOR, 1) == 2:
                block = np.cumsum(block.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
        out = block[: self.shape[0] - row, : self.shape[1] - column].astype(np.float64)
        try:
            out[out == float(self.tags[NO_DATA])] = np.nan
        except (KeyError, ValueError):
            pass
        return out


def unpack_lzw(data: bytes) -> bytes:
    """LZW as the format has it: codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, last, out, bits, have = list(first), 9, None, [], 0, 0
    for byte in data:
        bits, have = (bits << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


@dataclass
class Blocks(InputPartition):
    path: str
    numbers: list[int]


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.files = options["path"], options.get("what", "cells") == "files"
        self.most = int(options.get("cells", 1 << 20))
        self.low, self.high = {"x": -np.inf, "y": -np.inf}, {"x": np.inf, "y": np.inf}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of x and y choose blocks; Spark still tests every filter on the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("x",), ("y",)) and not self.files:
                c = f.attribute[0]
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[c] = max(self.low[c], float(f.value))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high[c] = min(self.high[c], float(f.value))
            yield f

    def meets(self, box: tuple[float, float, float, float]) -> bool:
        return box[0] <= self.high["x"] and box[2] >= self.low["x"] and box[1] <= self.high["y"] and box[3] >= self.low["y"]

    def partitions(self) -> list[Blocks]:
        """Only directories are read here: a few hundred bytes and eight for each block of a file."""
        if not self.files and (self.low["x"] > self.high["x"] or self.low["y"] > self.high["y"]):
            return [Blocks("", [])]
        out = []
        for path in listed(self.path):
            if self.files:
                out.append(Blocks(path, []))
                continue
            image = Image.read(path)
            wanted = [k for k in range(image.blocks) if self.meets(image.box(k))]
            each = max(1, self.most // (image.block[0] * image.block[1]))
            out += [Blocks(path, wanted[k : k + each]) for k in range(0, len(wanted), each)]
        return out or [Blocks("", [])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        image = Image.read(partition.path)
        (height, width), name = image.shape, image.name
        if self.files:
            (x0, y1), (x1, y0) = image.edges(0, 0), image.edges(width, height)
            yield pa.RecordBatch.from_pylist([{"tile": name, "min_x": x0, "min_y": y0, "max_x": x1, "max_y": y1, "width": width, "height": height}], schema=_FILES_ARROW)
            return
        with opened(partition.path) as f:
            for k in partition.numbers:
                block, (row, column) = image.values(f, k), image.corner(k)
                ry, rx = (n.ravel().astype(np.int32) for n in np.mgrid[row : row + block.shape[0], column : column + block.shape[1]])
                x, y = image.edges(rx + 0.5, ry + 0.5)
                v = block.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(rx), pa.array(ry), pa.array(x), pa.array(y), pa.array(v, mask=np.isnan(v))], schema=_CELLS_ARROW)


_CELLS_ARROW = pa.schema([("tile", pa.string()), ("rx", pa.int32()), ("ry", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("value", pa.float64())])
_FILES_ARROW = pa.schema([("tile", pa.string()), *((c, pa.float64()) for c in ("min_x", "min_y", "max_x", "max_y")), ("width", pa.int32()), ("height", pa.int32())])


def listed(path: str) -> list[str]:
    """The rasters below a folder, in order, or the one file."""
    uri = "://" in path or path.startswith("file:")
    fs, at = pafs.FileSystem.from_uri(path) if uri else (pafs.LocalFileSystem(), path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    lead = path[: path.index(at)] if uri and at in path else ""
    return sorted(lead + i.path for i in found if i.type == pafs.FileType.File and i.path.lower().endswith((".tif", ".tiff")))


class Rasters(DataSource):
    """Format "lumenfold_raster": cells (CELLS), or with option what=files one row for each file (FILES)."""

    @classmethod
    def name(cls) -> str:
        return "lumenfold_raster"

    def schema(self) -> str:
        return FILES if self.options.get("what") == "files" else CELLS

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader({**self.options})


def cells(spark: SparkSession, path: str, cells_a_task: int = 1 << 20) -> DataFrame:
    """tile, rx, ry (row 0 in the north), x, y of the centre and value of every cell; null where there is no data.

    Filters on x and y open only the blocks that they meet. A missing folder gives no rows, a broken file an error.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Rasters)
    return spark.read.format(Rasters.name()).option("cells", cells_a_task).load(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """tile, its box and size for every file: with cells(), what rasters.sample() takes."""
    spark.dataSource.register(Rasters)
    return spark.read.format(Rasters.name()).option("what", "files").load(path)


def encode(values: np.ndarray, west: float, north: float, size: float, block: tuple[int, int] | int, compression: int = DEFLATE, predictor: int = 1, no_data: float | None = None) -> bytes:
    """A file of one band (north up). block: (rows, columns) of tiles, or the rows of a strip."""
    values = np.ascontiguousarray(values)
    kind, (height, width) = values.dtype.newbyteorder("<"), values.shape
    rows, columns = (block, width) if isinstance(block, int) else block
    packed = []
    for r in range(0, height, rows):
        for c in range(0, width, columns):
            part = values[r : r + rows, c : c + columns]
            if not isinstance(block, int):
                part = np.pad(part, ((0, rows - part.shape[0]), (0, columns - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), part.dtype))
            raw = part.astype(kind).tobytes()
            if predictor == 3:
                planes = part.astype(kind.newbyteorder(">")).view(np.uint8).reshape(*part.shape, -1).transpose(0, 2, 1).reshape(len(part), -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((len(planes), 1), np.uint8)).tobytes()
            packed.append(zlib.compress(raw) if compression == DEFLATE else raw)
    starts = np.cumsum([8, *map(len, packed)]).tolist()
    tags = {
        WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [kind.itemsize * 8]), COMPRESSION: ("H", [compression]), BANDS: ("H", [1]), PREDICTOR: ("H", [predictor]),
        FORMAT: ("H", ["uif".index(kind.kind) + 1]), CELL_SIZE: ("d", [size, size, 0.0]), TIE_POINT: ("d", [0.0, 0.0, 0.0, west, north, 0.0]),
    }
    if isinstance(block, int):
        tags |= {STRIP_ROWS: ("I", [rows]), STRIPS: ("I", starts[:-1]), STRIP_BYTES: ("I", [len(p) for p in packed])}
    else:
        tags |= {TILE_WIDTH: ("I", [columns]), TILE_HEIGHT: ("I", [rows]), TILES: ("I", starts[:-1]), TILE_BYTES: ("I", [len(p) for p in packed])}
    if no_data is not None:
        tags[NO_DATA] = ("s", f"{no_data:g}".encode() + b"\0")
    codes, more, entries = {v: k for k, v in _TYPES.items() if k in (2, 3, 4, 12)}, b"", b""
    at = starts[-1] + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        code, v = tags[tag]
        raw = v if code == "s" else struct.pack(f"<{len(v)}{code}", *v)
        field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(more))
        more += raw if len(raw) > 4 else b""
        entries += struct.pack("<HHI", tag, codes[code], len(v)) + field
    return struct.pack("<2sHI", b"II", 42, starts[-1]) + b"".join(packed) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + more


def write(cells: DataFrame, folder: str, size: float, kind: str = "f4", block: tuple[int, int] | int = (64, 64), compression: int = DEFLATE, predictor: int = 1, no_data: float = -9999.0) -> None:
    """A file <tile>.tif for each tile of cells (tile, rx, ry, west, north, value): its upper left corner stands on every row.

    Cells without a row or value have no data. Each file is made by one task, which holds one tile. A null tile
    or place is an error.
    """
    def one(group: pd.DataFrame) -> pd.DataFrame:
        values = np.full((int(group.ry.max()) + 1, int(group.rx.max()) + 1), no_data, kind)
        has = group[group.value.notna()]
        values[has.ry.to_numpy(), has.rx.to_numpy()] = has.value.to_numpy()
        data = encode(values, float(group.west.iloc[0]), float(group.north.iloc[0]), size, block, compression, predictor, no_data)
        fs, at = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(at, recursive=True)
        part = f"{at}/.{group.tile.iloc[0]}.{os.getpid()}"
        with fs.open_output_stream(part) as out:
            out.write(data)
        fs.move(part, f"{at}/{group.tile.iloc[0]}.tif")  # whole or not at all, also when a task runs twice
        return pd.DataFrame({"n": [len(group)]})

    done = cells.select("tile", "rx", "ry", "west", "north", "value").groupBy("tile").applyInPandas(one, "n long")
    done.write.format("noop").mode("overwrite").save()
