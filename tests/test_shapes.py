import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import geo, rings
from lumenfold.operators import checks, contours, grids, rasters, spatial, windows
from lumenfold.sources import sinks, tilefiles


def test_repeated_points_keep_their_rows(spark):
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 5, 5), (0, 5.0, 0.0, 15.0, 10.0, 5, 5)], "tile int, min_x double, min_y double, max_x double, max_y double, width int, height int")
    cells = spark.createDataFrame([(t, x, y, 100.0 * t + 10 * x + y) for t in (0, 1) for x in range(5) for y in range(5)], "tile int, rx int, ry int, value double")
    points = spark.createDataFrame([("a", 1.0, 9.0), ("a", 1.0, 9.0), ("b", 6.0, 1.0), ("c", 99.0, 1.0), ("d", 10.0, 0.0)], "k string, sx double, sy double")
    got = sorted((r.k, r.value) for r in rasters.sample(points, tiles, cells).collect())
    assert got == [("a", 100.0), ("a", 100.0), ("b", 4.0), ("c", None), ("d", 24.0)]
    assert rasters.sample(points, tiles.limit(0), cells).where("value is null").count() == 5


def plain_hull(points):
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def test_hulls_and_clips_against_plain_python(spark):
    rng = random.Random(6)
    sets = [[(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    pts = lambda ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    df = spark.createDataFrame([(k, pts(s)) for k, s in enumerate(sets)], "k int, r array<struct<x:double,y:double>>")
    for row in df.select("k", rings.hull("r").alias("h")).collect():
        assert [(p.x, p.y) for p in row.h] == plain_hull(sets[row.k])
    stars = []
    for _ in range(25):
        n = rng.randint(3, 9)
        stars.append([(5 + rng.uniform(1, 6) * math.cos(2 * math.pi * k / n), 5 + rng.uniform(1, 6) * math.sin(2 * math.pi * k / n)) for k in range(n)])
    df = spark.createDataFrame([(k, pts(s)) for k, s in enumerate(stars)], "k int, r array<struct<x:double,y:double>>")
    out = df.select("k", rings.area(rings.clip("r", F.lit(2), F.lit(3), F.lit(7), F.lit(8))).alias("a"), rings.is_simple("r").alias("s"))
    for row in out.collect():
        ring, n = stars[row.k], 100
        inside = 0
        for i in range(n):
            for j in range(n):
                x, y, odd = 2 + 5 * (i + 0.5) / n, 3 + 5 * (j + 0.5) / n, False
                for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                    odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
                inside += odd
        assert row.s and abs(row.a - inside * 25 / n / n) < 0.1
    bow = spark.createDataFrame([(pts([(0, 0), (2, 2), (2, 0), (0, 2)]),), (pts([(0, 0), (4, 0), (4, 4), (2, 0)]),)], "r array<struct<x:double,y:double>>")
    assert [r.s for r in bow.select(rings.is_simple("r").alias("s")).collect()] == [False, False]


def test_polygons_meet_tiles_only_with_an_area(spark):
    ring = [{"x": x, "y": y} for x, y in ((10.0, 0.0), (20.0, 0.0), (10.0, 10.0))]
    df = spark.createDataFrame([(1, ring), (2, ring[:2])], "id int, ring array<struct<x:double,y:double>>")
    got = {(r.tile_e, r.tile_n): r.shared for r in spatial.polygons_in_tiles(df, 10.0).collect()}
    assert got == {(10.0, 0.0): 50.0}


def test_outlines_with_holes(spark):
    tiles = [(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)] + [(7, 7)]
    df = spark.createDataFrame(tiles, "i int, j int")
    comp = checks.components(df).select("i", "j", F.col("component.i").alias("component"))
    got = sorted((r.component, r.closed, len(r.points)) for r in contours.outline_rings(checks.outline_edges(df), comp).collect())
    assert got == [(0, True, 4), (0, True, 12), (7, True, 4)]
    ways = [(1, 2, [(1, 1), (1, 0)]), (1, 1, [(0, 0), (0, 1), (1, 1)]), (1, 3, [(0, 0), (1, 0)]), (2, 1, [(0, 0), (5, 5)]), (2, 2, [(9, 9)])]
    lines = spark.createDataFrame([(k, o, [{"x": float(x), "y": float(y)} for x, y in ps]) for k, o, ps in ways], "rel int, ord int, points array<struct<x:double,y:double>>")
    assert sorted((r.rel, r.closed, len(r.points)) for r in contours.stitched(lines, "rel").collect()) == [(1, True, 4), (2, False, 2)]


def test_isolines_close_around_a_peak(spark):
    cells = spark.createDataFrame([(i, j, 1.0 if (i, j) == (2, 2) else 0.0) for i in range(5) for j in range(5)], "i int, j int, value double")
    lines = contours.isolines(cells).select(F.lit(1).alias("k"), F.concat_ws(" ", "i", "j").alias("ord"), "points")
    (ring,) = contours.stitched(lines, "k").collect()
    assert ring.closed and {(p.x, p.y) for p in ring.points} == {(1.5, 2.0), (2.5, 2.0), (2.0, 1.5), (2.0, 2.5)}


def test_nearest_points_far_from_all_by_levels_of_cells(spark):
    rng = random.Random(4)
    right = [(k, rng.choice((-3000.0, 0.0, 5000.0)) + rng.uniform(0, 60), rng.uniform(-40, 40)) for k in range(300)] + [(300, None, 1.0), (301, -3000.0, 9000.0), (302, -3000.0, 9000.0)]
    left = [(k, rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for k in range(200)] + [(200, -3000.0, 9000.0), (201, None, 0.0)]
    a, b = spark.createDataFrame(left, "k int, x double, y double"), spark.createDataFrame(right, "o int, x double, y double")
    for square in (False, True):
        dist = (lambda p, q: max(abs(p[1] - q[1]), abs(p[2] - q[2]))) if square else (lambda p, q: math.dist(p[1:], q[1:]))
        got = {r.k: (r.o, r.distance) for r in spatial.nearest_point(a, b, "k", "o", 8.0, square).collect()}
        assert sorted(got) == list(range(201)) and got[200] == (301, 0.0)
        for p in left[:201]:
            assert abs(got[p[0]][1] - min(dist(p, q) for q in right if q[1] is not None)) < 1e-9


def test_boxes_and_points_by_cell_against_all_pairs(spark):
    rng = random.Random(6)
    boxes = [(k, x, y, x + rng.choice((0.0, 3.0, 90.0)), y + rng.uniform(0, 40)) for k in range(40) for x, y in [(rng.uniform(-100, 100), rng.uniform(-100, 100))]]
    points = [(k, rng.uniform(-150, 150), rng.uniform(-150, 150)) for k in range(200)] + [(200, boxes[3][1], boxes[3][2])]
    b, p = spark.createDataFrame(boxes, "id int, min_x double, min_y double, max_x double, max_y double"), spark.createDataFrame(points, "k int, x double, y double")
    want = {(i, k) for i, x0, y0, x1, y1 in boxes for k, x, y in points if x0 <= x <= x1 and y0 <= y <= y1}
    got = [(r.id, r.k) for r in spatial.boxes_with_points(b, p, 16.0).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.k for r in spatial.outside_all(p, b, 16.0).collect()} == set(range(201)) - {k for _, k in want}
    names = ["min_lon", "min_lat", "max_lon", "max_lat"]
    q = b.toDF("a", *(f"q_{n}" for n in names))
    met = [(r.a, r.id) for r in spatial.boxes_meeting(q, b.toDF("id", *names), degrees=16.0).select("a", "id").collect()]
    assert len(met) == len(set(met))
    assert set(met) == {(m[0], n[0]) for m in boxes for n in boxes if m[1] <= n[3] and m[3] >= n[1] and m[2] <= n[4] and m[4] >= n[2]}


def test_nearest_points_against_all_pairs(spark):
    rng = random.Random(9)
    left = [(k, rng.uniform(0, 1000), rng.uniform(0, 50)) for k in range(60)] + [(99, 4000.0, -5.0)]
    right = [(k, rng.uniform(0, 400), rng.uniform(0, 50)) for k in range(40)]
    a, b = spark.createDataFrame(left, "k int, x double, y double"), spark.createDataFrame(right, "o int, x double, y double")
    for square in (False, True):
        dist = (lambda p, q: max(abs(p[1] - q[1]), abs(p[2] - q[2]))) if square else (lambda p, q: math.dist(p[1:], q[1:]))
        got = {r.k: (r.o, r.distance) for r in spatial.nearest_point(a, b, "k", "o", 8.0, square).collect()}
        assert len(got) == len(left) and all(abs(got[p[0]][1] - min(dist(p, q) for q in right)) < 1e-9 for p in left)
    assert spatial.nearest_point(a, b.limit(0), "k", "o").count() == 0


def test_ranks_against_sorting(spark):
    rng = random.Random(3)
    rows = [(k % 4, v) for k in range(2000) for v in [rng.choice([1.0, 2.0, 2.5, None, rng.uniform(-5, 5)])]] + [(9, 7.0), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    ranks = {"lo": 0.0, "p50": 0.5, "p99": 0.99, "hi": 1.0}
    for bins in (1, 7, 4096):
        got = {r.g: [r[n] for n in ranks] for r in windows.nearest_ranks(df, ["g"], "v", ranks, bins).collect()}
        for g in (0, 1, 2, 3, 9):
            s = sorted(v for k, v in rows if k == g and v is not None)
            assert got[g] == [s[min(len(s) - 1, math.floor(q * len(s)))] for q in ranks.values()]
        assert 8 not in got


def test_floored_sums(spark):
    rng = random.Random(5)
    rows = [(k % 3, k, rng.choice([-1, 1])) for k in range(300)]
    got = {r.t: r.now for r in windows.floored_sums(spark.createDataFrame(rows, "g int, t int, d int"), ["g"], ["t"], "d").collect()}
    now = {}
    for g, t, d in rows:
        now[g] = max(0, now.get(g, 0) + d)
        assert got[t] == now[g]


def test_region_tiles_cover_their_region(spark):
    box = spark.createDataFrame([("r", 6.6, 46.5, 6.62, 46.51)], "region string, min_lon double, min_lat double, max_lon double, max_lat double")
    tiles = grids.region_tiles(box)
    got = {(r.min_e, r.min_n) for r in tiles.collect()}
    points = spark.range(400).select((6.6 + (F.col("id") % 20) * 0.001).alias("lon"), (46.5 + F.floor(F.col("id") / 20) * 0.0005).alias("lat")).select(geo.to_plane("lon", "lat").alias("p"))
    assert {(math.floor(r.p.e / 250) * 250.0, math.floor(r.p.n / 250) * 250.0) for r in points.collect()} <= got
    assert all(e % 250 == 0 and n % 250 == 0 for e, n in got) and len(got) == tiles.count() <= 80
    far = tiles.where("lon1 < 6.6 or lon0 > 6.62 or lat1 < 46.5 or lat0 > 46.51")
    assert far.count() == 0


def test_tile_files(spark):
    frames = [{"minute": 480, "altitude": 12.5, "mask": b"\x01\x02"}, {"minute": 495, "altitude": -1.0, "mask": b""}]
    blob = tilefiles.encode(9, frames)
    assert tilefiles.decode(blob) == (9, frames) and blob == tilefiles.encode(9, frames)
    import gzip

    raw = gzip.decompress(blob)
    for broken in (raw[:-1], b"XXXX" + raw[4:], raw + b"y", raw[:20]):
        with pytest.raises(ValueError):
            tilefiles.decode(gzip.compress(broken))
    df = spark.createDataFrame([("t", 9, frames), ("u", 0, [])], f"tile string, points int, frames {tilefiles.FRAMES}")
    back = tilefiles.decoded(tilefiles.encoded(df, "tile"), "tile")
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_prisms(spark):
    ring = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0))]
    df = spark.createDataFrame([(1, ring), (2, ring[:2])], "id int, ring array<struct<x:double,y:double>>")
    t = df.select("id", F.explode(rings.extruded("ring", F.lit(1), F.lit(6))).alias("t")).groupBy("id", "t.part").agg(F.count("*").alias("n"), F.sum(rings.triangle_area(F.col("t"))).alias("a"))
    assert {(r.id, r.part): (r.n, r.a) for r in t.collect()} == {(1, "roof"): (2, 12.0), (1, "floor"): (2, 12.0), (1, "wall"): (8, 70.0)}


def test_scratch_folders_are_in_the_shared_one(spark):
    assert sinks.scratch_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
