"""Building files: drawings in exchange format, one or more in a zip archive, read as polyfaces, triangles and obstacles.

A drawing is a list of (group code, value) line pairs. They stream from the archive through a small state
machine, so a task holds its archive as it is packed, and of the drawing one polyface.
"""

from __future__ import annotations

import io
import math
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Group codes, and flags of vertices. (Fixed values.)
START, NAME, X, Y, Z, FLAG, CORNERS = 0, 2, 10, 20, 30, 70, (71, 72, 73, 74)
PLACE, FACE = 64, 128

POLYFACES = "source string, member string, n int, points array<struct<x:double,y:double,z:double>>, faces array<array<int>>, error string"


@dataclass
class Vertex:
    place: dict[int, float] = field(default_factory=dict)
    flag: int = 0
    corners: list[int] = field(default_factory=list)


@dataclass
class Polyface:
    """Points, and faces as numbers of points from 1 (negative: the edge that begins there is hidden)."""

    points: list[tuple[float, float, float]] = field(default_factory=list)
    faces: list[list[int]] = field(default_factory=list)

    def take(self, v: Vertex) -> None:
        """A vertex is a point, or (only FACE is set) a face. One of neither kind, or without its three numbers, is passed over."""
        if v.flag & FACE and not v.flag & PLACE:
            if len(v.corners) >= 3:
                self.faces.append(v.corners)
        elif len(v.place) == 3:
            self.points.append((v.place[X], v.place[Y], v.place[Z]))


class Broken(ValueError):
    """A drawing that ends within a group, or an archive that cannot be read."""


def groups(lines: Iterable[str]) -> Iterator[tuple[int, str]]:
    """Pairs of code and value. A code that is no whole number is an error."""
    code = None
    for number, line in enumerate(lines):
        if code is None:
            try:
                code = int(line)
            except ValueError:
                if line.strip():
                    raise Broken(f"line {number + 1}: no group code") from None
        else:
            yield code, line.strip()
            code = None
    if code is not None:
        raise Broken("ends after a group code")


def number(value: str) -> float | None:
    try:
        out = float(value)
    except ValueError:
        return None
    return out if math.isfinite(out) else None


def polyfaces(lines: Iterable[str]) -> Iterator[Polyface]:
    """The polylines of the section ENTITIES that have a point, in order; each ends at SEQEND, the next entity or the section's end."""
    section_next = inside = False
    now: Polyface | None = None
    vertex: Vertex | None = None
    for code, value in groups(lines):
        if code == START:
            if vertex is not None and now is not None:
                now.take(vertex)
            vertex = None
            if value == "VERTEX" and now is not None:
                vertex = Vertex()
                continue
            if now is not None:
                if now.points:
                    yield now
                now = None
            if value == "SECTION":
                section_next = True
            elif value == "ENDSEC":
                section_next = inside = False
            elif value == "POLYLINE" and inside:
                now = Polyface()
        elif section_next and code == NAME:
            inside, section_next = value == "ENTITIES", False
        elif vertex is not None and (n := number(value)) is not None:
            if code in (X, Y, Z):
                vertex.place[code] = n
            elif code == FLAG:
                vertex.flag = int(n)
            elif code in CORNERS and n:
                vertex.corners.append(int(n))
    if vertex is not None and now is not None:
        now.take(vertex)
    if now is not None and now.points:
        yield now


def members(archive: bytes) -> Iterator[tuple[str, Iterator[Polyface]]]:
    """The drawings of an archive and their polyfaces, inflated as they are read."""
    try:
        with zipfile.ZipFile(io.BytesIO(archive)) as z:
            for info in z.infolist():
                if not info.is_dir() and info.filename.lower().endswith(".dxf"):
                    yield info.filename, _streamed(z, info)
    except zipfile.BadZipFile as e:
        raise Broken(str(e)) from None


def _streamed(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> Iterator[Polyface]:
    try:
        with z.open(info) as f:
            yield from polyfaces(io.TextIOWrapper(f, "latin-1"))
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
        raise Broken(str(e)) from None


def _rows(source: str, archive: bytes) -> Iterator[dict]:
    """A row for each polyface; where a member or the archive breaks off, one with what is wrong, and the next member goes on."""
    try:
        for member, faces in members(archive):
            n = 0
            try:
                for p in faces:
                    yield {"source": source, "member": member, "n": n, "points": [dict(zip("xyz", xyz, strict=True)) for xyz in p.points], "faces": p.faces, "error": None}
                    n += 1
            except Broken as e:
                yield {"source": source, "member": member, "n": n, "points": None, "faces": None, "error": str(e)}
    except Broken as e:
        yield {"source": source, "member": None, "n": None, "points": None, "faces": None, "error": str(e)}


_ARROW = pa.schema([
    ("source", pa.string()), ("member", pa.string()), ("n", pa.int32()), ("points", pa.list_(pa.struct([(c, pa.float64()) for c in "xyz"]))),
    ("faces", pa.list_(pa.list_(pa.int32()))), ("error", pa.string()),
])


def read_polyfaces(spark: SparkSession, folder: str, batch: int = 500) -> DataFrame:
    """POLYFACES of every *.zip below a folder: n counts from 0 in a member; rows with an error have neither points nor faces.

    What a broken member holds before it breaks is kept. An archive is one cell (of less than 2 GB).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(folder)

    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                rows = []
                for row in _rows(path.as_py().rsplit("/", 1)[-1], content.as_py()):
                    rows.append(row)
                    if len(rows) == batch:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("path", "content").mapInArrow(parsed, POLYFACES)


def triangles(faces: DataFrame, *keys: str) -> DataFrame:
    """keys and the corners ax, ay, az, ..., cz of every face of polyfaces; one of four corners gives two.

    Faces that name no point of their polyface, and triangles of no area, are left out.
    """
    at = lambda c: F.try_element_at("points", F.abs(c))
    three = lambda f, i, j, k: F.struct(at(f[i]).alias("a"), at(f[j]).alias("b"), at(f[k]).alias("c"))
    cut = F.flatten(F.transform("faces", lambda f: F.when(F.size(f) >= 4, F.array(three(f, 0, 1, 2), three(f, 0, 2, 3))).otherwise(F.array(three(f, 0, 1, 2)))))
    out = faces.where("error is null").select(*keys, F.explode(cut).alias("t"))
    flat = out.select(*keys, *(F.col(f"t.{p}.{c}").alias(f"{p}{c}") for p in "abc" for c in "xyz")).dropna()
    u, v = ({c: F.col(f"{p}{c}") - F.col(f"a{c}") for c in "xyz"} for p in "bc")
    cross = (u["y"] * v["z"] - u["z"] * v["y"], u["z"] * v["x"] - u["x"] * v["z"], u["x"] * v["y"] - u["y"] * v["x"])
    return flat.where(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2] > 0)


def _three(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5) / 1000


def obstacles(faces: DataFrame, box: tuple[float, float, float, float] | None = None, least_side: float = 1.0, least_area: float = 4.0) -> DataFrame:
    """source, member, n, the box, centre and half diagonal (to the millimetre) of polyfaces that are large enough.

    At least four points; width, depth and height of ``least_side`` or more and ``least_area`` on the ground. box: (min_x, min_y, max_x,
    max_y), which they must meet, edges included.
    """
    ends = [f(f"points.{c}").alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.array_min), ("max", F.array_max))]
    o = faces.where("error is null and size(points) >= 4").select("source", "member", "n", *ends)
    w, d, h = (F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz")
    o = o.where((w >= least_side) & (d >= least_side) & (h >= least_side) & (w * d >= least_area))
    if box is not None:
        o = o.where((F.col("max_x") >= box[0]) & (F.col("min_x") <= box[2]) & (F.col("max_y") >= box[1]) & (F.col("min_y") <= box[3]))
    mid = lambda c: _three((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"center_{c}")
    sides = [_three(F.col(f"{n}_{c}")).alias(f"{n}_{c}") for c in "xyz" for n in ("min", "max")]
    return o.select("source", "member", "n", *sides, _three(h).alias("height"), mid("x"), mid("y"), _three(F.hypot(w, d) / 2).alias("half_diagonal"))


def broken(faces: DataFrame) -> DataFrame:
    """source, member, error of the members and archives that could not be read to their end."""
    return faces.where("error is not null").select("source", "member", "error")


def drawing(shapes: Iterable[tuple[list[tuple[float, float, float]], list[list[int]]]]) -> Iterator[str]:
    """The lines of a drawing of polyfaces (points, faces as numbers from 1)."""
    def pair(code: int, value: object) -> str:
        return f"{code:3d}\n{value}\n"

    yield pair(START, "SECTION") + pair(NAME, "ENTITIES")
    for points, faces in shapes:
        yield pair(START, "POLYLINE") + pair(FLAG, PLACE)
        for x, y, z in points:
            yield pair(START, "VERTEX") + pair(X, x) + pair(Y, y) + pair(Z, z) + pair(FLAG, PLACE | FACE)
        for f in faces:
            yield pair(START, "VERTEX") + "".join(pair(c, 0) for c in (X, Y, Z)) + pair(FLAG, FACE) + "".join(pair(c, k) for c, k in zip(CORNERS, f, strict=False))
        yield pair(START, "SEQEND")
    yield pair(START, "ENDSEC") + pair(START, "EOF")


def archive(shapes: Iterable[tuple[list, list]], member: str) -> bytes:
    """A zip with one drawing."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w") as f:
        for text in drawing(shapes):
            f.write(text.encode("latin-1"))
    return out.getvalue()
