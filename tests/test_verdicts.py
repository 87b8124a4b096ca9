import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import evaluator, meshes


def crossing(o, d, tri):
    """Where a ray meets a triangle, by solving for the plane's point: a formula of its own."""
    a, b, c = (np.array(p) for p in tri)
    m = np.column_stack([b - a, c - a, -np.array(d)])
    if abs(np.linalg.det(m)) < 1e-9:
        return math.inf
    u, v, t = np.linalg.solve(m, np.array(o) - a)
    return t if u >= 0 and v >= 0 and u + v <= 1 and t > 1e-9 else math.inf


@pytest.mark.parametrize("n", [1, 12, 13, 400])
def test_tree_finds_what_all_pairs_find(n):
    rng = np.random.default_rng(n)
    corners = rng.uniform(-50, 50, (n, 1, 3)) + rng.uniform(-8, 8, (n, 3, 3))
    owner = rng.integers(0, 3, n)
    origin, way = rng.uniform(-60, 60, (120, 3)), rng.normal(size=(120, 3))
    way[:20, 2] = 0
    way[20:30] = [0, 0, 1]
    way /= np.linalg.norm(way, axis=1)[:, None]
    of, most = rng.integers(0, 3, 120), rng.uniform(20, 200, 120)
    got = meshes.nearest(corners, owner, origin, way, of, most)
    for k in range(120):
        want = min((crossing(origin[k], way[k], tri) for tri in corners[owner == of[k]]), default=math.inf)
        want = want if want <= most[k] else math.inf
        assert got[k] == want or abs(got[k] - want) < 1e-6


def test_boxes_halve_down_to_leaves():
    rng = np.random.default_rng(2)
    low = np.concatenate([rng.uniform(0, 9, (300, 3)), np.zeros((100, 3))])
    tree = meshes.build(low, low + 1, 12)
    leaf = tree.left < 0
    assert sorted(tree.order.tolist()) == list(range(400)) and (tree.last - tree.first)[leaf].max() <= 12 and (tree.last - tree.first)[leaf].sum() == 400


def mesh(spark, triangles):
    return spark.createDataFrame([(i, *(float(v) for p in tri for v in p)) for i, tri in triangles], "id long, " + ", ".join(f"{c} double" for c in meshes.TRIANGLE))


def test_blocks_chunks_and_defined_cases(spark):
    rng = random.Random(4)
    wall = lambda x, y: [(x, y - 60, 0), (x + 9, y + 60, 0), (x, y, 250)]
    triangles = [(k % 9, wall(rng.uniform(0, 900), rng.uniform(0, 900))) for k in range(500)] + [(45, [(1, 1, 1)] * 3)]
    pairs = [(k, rng.randrange(10), rng.uniform(0, 900), rng.uniform(0, 900), 1.0, rng.uniform(0, 360), rng.uniform(-5, 20)) for k in range(400)]
    pairs += [(900, 1, None, 1.0, 1.0, 1.0, 1.0), (901, None, 1.0, 1.0, 1.0, 1.0, 1.0), pairs[0]]
    df = spark.createDataFrame(pairs, "probe long, id long, x double, y double, z double, azimuth double, altitude double")
    want = {}
    for p, i, x, y, z, az, alt in pairs[:400]:
        flat = math.cos(math.radians(alt))
        d = (math.sin(math.radians(az)) * flat, math.cos(math.radians(az)) * flat, math.sin(math.radians(alt)))
        t = min((crossing((x, y, z), d, tri) for j, tri in triangles if j == i), default=math.inf)
        if alt > 0 and t * flat <= 600:
            want[p, i] = math.floor(t * flat * 1000 + 0.5) / 1000
    m = mesh(spark, triangles)
    for block, chunk in ((10**6, 10**6), (30, 25)):
        got = {(r.probe, r.id): r.distance for r in meshes.mesh_hits(df, m, 600.0, block=block, chunk=chunk).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.002 for k in got) and len(got) > 20
    assert meshes.mesh_hits(df.limit(0), m, 600.0).collect() == [] and meshes.mesh_hits(df, m.limit(0), 600.0).collect() == []


def hits(spark, rows):
    """Hits with the sun at 10 degrees; their prisms' tops stand at the given angles."""
    return spark.createDataFrame([(0, i, d, a, 10.0, 0.0, 0.0, 1.0, 0.0) for i, d, a in rows], "probe long, id long, distance double, angle double, altitude double, x double, y double, z double, azimuth double")


def test_two_levels(spark):
    wall = lambda y, top: [(-5, y, 0), (5, y, 0), (0, y, top)]
    m = mesh(spark, [(k, wall(10 * k, 1.5)) for k in range(1, 9)] + [(20, wall(30, 90))])
    first = lambda rows, near, steps: [(r.blocker, r["rank"]) for r in meshes.verified_by_mesh(hits(spark, rows), m, 400.0, near, steps).collect()]
    low = [(k, 10.0 * k, 11.0) for k in range(1, 9)]
    assert first(low, 2.0, 3) == [(5, 5)]  # four are cleared, the next blocks unseen
    assert first(low, 90.0, 32) == []
    assert first(low[:2] + [(20, 30.0, 11.0)], 2.0, 3) == [(20, 3)]
    assert first([(1, 10.0, 40.0), *low[1:]], 2.0, 3) == [(1, 1)]  # far above the sun: not asked
    assert first([(99, 5.0, 10.5), *low], 2.0, 3) == [(99, 1)]  # no mesh
    with pytest.raises(ValueError):
        meshes.building_blockers(hits(spark, low), m, 1.0, "raster")


def test_steps_see_only_what_is_clear_and_each_bucket_once(spark):
    points = spark.createDataFrame([(t, i, float(i), 0.0, 0.0) for t in (1, 2) for i in (0, 3, 40)] + [(1, None, 0.0, 0.0, 0.0)], "tile int, i int, x double, y double, z double")
    suns = spark.createDataFrame([(1, k, 10.0 + k * 0.01, 5.0) for k in range(50)] + [(1, 50, 200.0, 30.0), (1, 51, 90.0, -4.0), (2, 0, 200.0, 30.0), (3, 0, 200.0, 30.0)], "tile int, frame int, azimuth double, altitude double")
    seen = {}

    def of(name, blocked):
        def step(rays):
            seen[name] = sorted((r.ray.tile, r.ray.az_b, r.ray.i) for r in rays.select("ray").collect())
            return rays.where(blocked).select("ray")

        return step

    profile = spark.createDataFrame([(b, 20.0 if b < 90 else 0.0) for b in range(360)], "az_bin int, angle double")
    steps = dict(ground=of("ground", F.col("ray.i") == 0), built=of("built", F.col("ray.i") == 3), green=of("green", F.col("ray.i") == 3))
    got = {(r.tile, r.frame): r for r in evaluator.frame_masks(points, suns, 5.0, profile=profile, **steps).collect()}
    assert seen["ground"] == sorted((t, 40, i) for t in (1, 2) for i in (0, 3, 40))  # the horizon hides the low sun, 50 frames are one bucket
    assert seen["built"] == seen["green"] == sorted((t, 40, i) for t in (1, 2) for i in (3, 40))
    assert set(got) == {(1, k) for k in range(52)} | {(2, 0)}
    low, noon, night = got[1, 7], got[1, 50], got[1, 51]
    assert low.terrain == [9, 256] and low.sun == [0, 0] and low.sunny == 0
    assert (noon.terrain, noon.buildings, noon.vegetation, noon.sun) == ([1, 0], [8, 0], [8, 0], [0, 256]) and noon.sunny == 1 and noon.sunny_without_vegetation == 1
    assert night.terrain == night.sun == [0, 0]
    all_ = {(r.tile, r.frame): r for r in evaluator.frame_masks(points, suns, 5.0, profile=profile, all_blockers=True, **steps).collect()}
    assert all_[1, 7].buildings == [8, 0] and all_[1, 7].sun == [0, 0] and len(seen["built"]) == 9


def test_no_steps_no_points(spark):
    points = spark.createDataFrame([(1, 31, 0.0, 0.0, 0.0), (1, 32, 0.0, 0.0, 0.0)], "tile int, i int, x double, y double, z double")
    suns = spark.createDataFrame([(1, 0, 10.0, 5.0)], "tile int, frame int, azimuth double, altitude double")
    r = evaluator.frame_masks(points, suns).first()
    assert r.sun == [1 << 31, 1] and r.terrain == [0, 0] and r.sunny == 2
    assert evaluator.frame_masks(points.limit(0), suns).collect() == [] and evaluator.frame_masks(points, suns.limit(0)).collect() == []


def test_masks_are_the_verdicts_of_the_order(spark):
    """All sixteen cases of the four steps against sun.verdict()."""
    from lumenfold.functions import sun

    cases = list(itertools.product([False, True], repeat=4))
    rays = spark.createDataFrame([((1, 0, 1, k), *c, 45.0, 10.0) for k, c in enumerate(cases)], "ray struct<tile:int,az_b:int,alt_b:int,i:int>, h boolean, t boolean, b boolean, v boolean, azimuth double, altitude double")
    for all_ in (False, True):
        step = lambda c: lambda df: df.where(c)
        got = evaluator.verdicts(rays, ground=step("h or t"), built=step("b"), green=step("v"), all_blockers=all_).orderBy("ray.i").collect()
        want = rays.select(sun.verdict(F.lit(True), F.col("h"), F.col("t"), F.col("b"), F.col("v"), all_).alias("w"), "ray.i").orderBy("i").collect()
        assert [(g.terrain, g.buildings, g.vegetation, g.sun) for g in got] == [tuple(w.w) for w in want]
