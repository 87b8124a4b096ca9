import datetime
import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from lumenfold.sources import buildingfiles, rasterfiles, readers, sinks, tilefiles


def grid(kind="f4", shape=(37, 53)):
    out = (np.random.default_rng(1).integers(0, 90, shape) + (0.25 if kind[0] == "f" else 0)).astype(kind)
    out[3, 4] = 99
    return out


def saved(tmp_path, data, name="a.tif"):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def read(spark, path, **more):
    got = rasterfiles.cells(spark, path, **more).collect()
    return {(r.tile, r.rx, r.ry): r.value for r in got}, got


@pytest.mark.parametrize("kind, block, compression, predictor", [
    ("f4", (16, 16), rasterfiles.DEFLATE, 3), ("f8", (16, 32), rasterfiles.DEFLATE, 3), ("f4", 7, rasterfiles.PLAIN, 1), ("i2", (16, 16), rasterfiles.DEFLATE, 2),
    ("u1", 1, rasterfiles.DEFLATE, 2), ("u2", 100, rasterfiles.PLAIN, 2), ("i4", (64, 64), rasterfiles.PLAIN, 1),
])
def test_round_trips(spark, tmp_path, kind, block, compression, predictor):
    v = grid(kind)
    got, rows = read(spark, saved(tmp_path, rasterfiles.encode(v, 100.0, 50.0, 0.5, block, compression, predictor, 99)))
    assert got == {("a", x, y): None if v[y, x] == 99 else float(v[y, x]) for y in range(37) for x in range(53)}
    assert all(r.x == 100 + (r.rx + 0.5) * 0.5 and r.y == 50 - (r.ry + 0.5) * 0.5 for r in rows)
    f = rasterfiles.files(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in f] == [("a", 100.0, 31.5, 126.5, 50.0, 53, 37)]


def lzw(data):
    """A plain encoder: codes grow one entry before the table does, the table is cleared in time."""
    out, bits, n = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            out.append(bits >> n - 8 & 255)
            n -= 8
            bits &= (1 << n) - 1

    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    put(256, 9)
    for b in data:
        more = word + bytes([b])
        if more in table:
            word = more
            continue
        put(table[word], width)
        table[more] = len(table) + 2
        if len(table) + 2 == 4094:
            put(256, 12)
            table, width = {bytes([k]): k for k in range(256)}, 9
        else:
            width = max(9, (len(table) + 2).bit_length())
        word = bytes([b])
    put(table[word], width)
    put(257, width)
    put(0, 7)
    return bytes(out)


@pytest.mark.parametrize("n", [1, 5, 600, 40_000])
def test_lzw(n):
    data = np.random.default_rng(n).integers(0, 40, n).astype(np.uint8).tobytes()
    assert rasterfiles.unpack_lzw(lzw(data)) == data
    assert rasterfiles.unpack_lzw(lzw(b"ab" * n)) == b"ab" * n


def test_filters_open_only_the_blocks_they_meet(spark, tmp_path):
    v = grid("i2", (64, 96))
    path = saved(tmp_path, rasterfiles.encode(v, 0.0, 64.0, 1.0, (16, 16), rasterfiles.DEFLATE, 2))
    reader = rasterfiles.RasterReader({"path": path, "cells": "256"})
    filters = [GreaterThan(("x",), 17.0), LessThanOrEqual(("x",), 33.0), EqualTo(("y",), 50.5), EqualTo(("value",), 3.0)]
    assert list(reader.pushFilters(filters)) == filters
    assert [(p.numbers) for p in reader.partitions()] == [[1], [2]]
    assert len(rasterfiles.RasterReader({"path": path, "cells": "256"}).partitions()) == 24
    assert [p.numbers for p in rasterfiles.RasterReader({"path": path, "cells": "1024"}).partitions()][0] == [0, 1, 2, 3]
    box = rasterfiles.cells(spark, path, 256).where("x > 17 and x <= 33 and y = 50.5")
    assert {(r.rx, r.ry): r.value for r in box.collect()} == {(x, 13): float(v[13, x]) for x in range(17, 33)} and box.rdd.getNumPartitions() == 2
    assert rasterfiles.cells(spark, path).where("x > 500").collect() == [] and rasterfiles.cells(spark, path).where("x > 5 and x < 2").collect() == []


def swapped(values, west, north, size, large):
    """The same image by hand: big-endian, one plain strip, with the long form of the directory if large."""
    raw = values.astype(values.dtype.newbyteorder(">")).tobytes()
    count, entry, word = ("Q", "HHQ", 8) if large else ("H", "HHI", 4)
    tags = [(256, 3, [values.shape[1]]), (257, 3, [values.shape[0]]), (258, 3, [values.dtype.itemsize * 8]), (259, 3, [1]), (273, 4, [16]), (278, 3, [values.shape[0]]), (279, 4, [len(raw)]),
            (339, 3, ["uif".index(values.dtype.kind) + 1]), (33550, 12, [size, size, 0.0]), (33922, 12, [0.0, 0.0, 0.0, west, north, 0.0])]
    at = 16 + len(raw)
    after, rows, more = at + struct.calcsize(">" + count) + len(tags) * (12 if word == 4 else 20) + word, b"", b""
    for tag, kind, v in tags:
        data = struct.pack(f">{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[kind] }", *v)
        place = data.ljust(word, b"\0") if len(data) <= word else struct.pack(">Q" if large else ">I", after + len(more))
        more += data if len(data) > word else b""
        rows += struct.pack(">" + entry, tag, kind, len(v)) + place
    head = struct.pack(">2sHHHQ", b"MM", 43, 8, 0, at) if large else struct.pack(">2sHIQ", b"MM", 42, at, 0)
    return head + raw + struct.pack(">" + count, len(tags)) + rows + b"\0" * word + more


@pytest.mark.parametrize("large", [False, True])
def test_other_byte_order_and_large_files(spark, tmp_path, large):
    v = grid("f8", (5, 6))
    got, _ = read(spark, saved(tmp_path, swapped(v, 10.0, 20.0, 2.0, large)))
    assert got == {("a", x, y): v[y, x] for y in range(5) for x in range(6)}


def test_broken_and_missing_rasters(spark, tmp_path):
    assert read(spark, str(tmp_path / "none"))[0] == {}
    for data in (b"", b"II*\0", b"PK\3\4" * 9):
        with pytest.raises(Exception, match="tagged image|unpack|buffer"):
            read(spark, saved(tmp_path, data))


def test_written_by_tasks(spark, tmp_path):
    rows = [(t, x, y, 10.0, 20.0 - 4 * k, None if x == 2 else float(x + y)) for k, t in enumerate(("a", "b")) for x in range(5) for y in range(4) if (x, y) != (0, 0)]
    df = spark.createDataFrame(rows, "tile string, rx int, ry int, west double, north double, value double")
    rasterfiles.write(df, str(tmp_path / "out"), 1.0, block=(2, 2), predictor=3)
    got, _ = read(spark, str(tmp_path / "out"))
    assert {k: v for k, v in got.items() if v is not None} == {r[:3]: r[5] for r in rows if r[5] is not None} and len(got) == 40


def zipped(folder, name, **members):
    with zipfile.ZipFile(folder / name, "w", zipfile.ZIP_DEFLATED) as z:
        for member, text in members.items():
            z.writestr(member.replace("_", "."), text)


CUBE = ([(x, y, z) for z in (0.0, 3.0) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))], [[1, 2, 3, 4], [5, 6, -7], [9, 1, 2], [1, 1, 2]])


def test_drawings(spark, tmp_path):
    text = "".join(buildingfiles.drawing([CUBE, CUBE]))
    assert [(p.points, p.faces) for p in buildingfiles.polyfaces(io.StringIO(text))] == [(CUBE[0], CUBE[1])] * 2
    zipped(tmp_path, "a.zip", one_DXF=text, two_dxf=text.replace("\n", "\r\n"), note_txt="x")
    zipped(tmp_path, "b.zip", cut_dxf=text[: text.rindex(" 10\n") + 4], none_dxf="", junk_dxf="what is\nthis\n")
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "c.zip").write_bytes(whole[: len(whole) // 2])
    faces = buildingfiles.read_polyfaces(spark, str(tmp_path)).cache()
    got = {(r.source, r.member, r.n) for r in faces.where("error is null").collect()}
    assert got == {("a.zip", m, n) for m in ("one.DXF", "two.dxf") for n in (0, 1)} | {("b.zip", "cut.dxf", 0)}
    assert {(r.source, r.member) for r in buildingfiles.broken(faces).collect()} == {("b.zip", "cut.dxf"), ("b.zip", "junk.dxf"), ("c.zip", None)}
    t = buildingfiles.triangles(faces, "source", "member", "n")
    assert t.groupBy("source", "member", "n").count().select("count").distinct().collect() == [(3,)]  # two of the square, one; none of what names no point or has no area
    o = buildingfiles.obstacles(faces).collect()
    assert len(o) == 5 and {(r.min_x, r.max_y, r.height, r.center_x, r.half_diagonal) for r in o} == {(0.0, 4.0, 3.0, 2.0, 2.828)}
    assert buildingfiles.obstacles(faces, (4.0, 4.0, 9.0, 9.0)).count() == 5 and buildingfiles.obstacles(faces, (4.1, 0.0, 9.0, 9.0)).count() == 0
    assert buildingfiles.obstacles(faces, least_area=17.0).count() == 0


def test_what_lies_outside_of_entities_is_passed_over():
    pairs = ["0", "SECTION", "2", "BLOCKS", "0", "POLYLINE", "0", "VERTEX", "10", "1", "20", "1", "30", "1", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES",
             "0", "VERTEX", "10", "7", "0", "POLYLINE", "10", "5", "0", "VERTEX", "10", "1", "20", "2", "30", "x", "0", "VERTEX", "10", "1", "20", "2", "30", "3", "70", "junk",
             "0", "LINE", "10", "9", "0", "VERTEX", "10", "9", "20", "9", "30", "9", "0", "POLYLINE", "0", "VERTEX", "10", "4", "20", "4", "30", "4", "0", "ENDSEC", "0", "EOF"]
    got = list(buildingfiles.polyfaces("\n".join(pairs).split("\n")))
    assert [p.points for p in got] == [[(1.0, 2.0, 3.0)], [(4.0, 4.0, 4.0)]]


def test_broken_keys_come_from_the_index(spark, tmp_path):
    index, keys = str(tmp_path / "index"), tmp_path / "keys"
    rows = [("r", 0.75, f"t{k % 3}", k % 7, k % 5, float(k)) for k in range(70)]
    buckets = spark.createDataFrame(rows, "region string, res double, tile_id string, az_b int, alt_b int, value double")
    sinks.write_index(buckets, index)
    sinks.write_index_keys(buckets.where("tile_id <> 't1'").repartition(4, "tile_id"), str(keys))
    for name, garbage in (("part-x.parquet", b"PAR1 cut short"), ("part-y.parquet", b"")):
        (keys / name).write_bytes(garbage)
    want = {(r[2], r[3], r[4]) for r in rows}
    got = [(r.tile_id, r.az_b, r.alt_b) for r in readers.index_keys_beside(spark, str(keys), index).collect()]
    assert len(got) == len(want) and set(got) == want


def test_dated_tiles_prune_days(spark, tmp_path):
    frames = [{"minute": 60, "altitude": 1.5, "mask": b"\x01"}]
    days = [datetime.date(2024, 1, d) for d in range(1, 6)]
    tiles = spark.createDataFrame([(f"{d}|a|b", 8, frames) for d in days], f"key string, points int, frames {tilefiles.FRAMES}")
    stored = tilefiles.encoded(tiles, "key").selectExpr("substring(key, 12) AS tile", "artifact", "to_date(substring(key, 1, 10)) AS day")
    stored.write.partitionBy("day").parquet(str(tmp_path / "t"))
    got = readers.dated_tiles(spark, str(tmp_path / "t"), "2024-01-02", "2024-01-04")
    assert sorted((r.day, r.tile, r.points) for r in got.collect()) == [(d, "a|b", 8) for d in days[1:4]]
    assert readers.dated_tiles(spark, str(tmp_path / "t")).count() == 5
    spark.read.parquet(str(tmp_path / "t")).limit(1).selectExpr("tile", "cast('x' as binary) as artifact").write.parquet(str(tmp_path / "t" / "day=2024-01-09"))
    assert got.count() == 3  # the damaged artifact of another day is not opened
