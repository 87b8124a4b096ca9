import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import rings
from lumenfold.operators import footprints

SCHEMA = "id int, ring array<struct<x:double,y:double>>"


def frame(spark, *shapes):
    return spark.createDataFrame([(k, None if s is None else [{"x": float(x), "y": float(y)} for x, y in s]) for k, s in enumerate(shapes)], SCHEMA)


def normal(spark, *shapes):
    got = footprints.normalised(frame(spark, *shapes)).orderBy("id").collect()
    return [(None if r.footprint is None else [(p.x, p.y) for p in r.footprint], r.used_hull) for r in got]


L = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]
SPIKY = [(0, 0), (3.6, 3.6), (8, 0.5), (4.2, 4.0), (12, 1), (4.8, 4.3), (11.5, 8), (5, 5), (12, 12), (4.4, 5.5), (1, 12), (4, 4.8)]


def test_footprints(spark):
    bow, pentagram = [(0, 0), (4, 4), (4, 0), (0, 4)], [(math.cos(2.4 * k * math.pi / 3), math.sin(2.4 * k * math.pi / 3)) for k in range(5)]
    flat, two = [(0, 0), (1, 1), (2, 2), (3, 3)], [(0, 0), (1, 1), (0, 0)]
    repeats = [(0, 0), (0.0001, 0), (5, 0), (5, 5), (0, 0)]
    got = normal(spark, L, SPIKY, bow, pentagram, flat, two, repeats, None, [])
    assert got[0] == (L, False)
    assert got[1][1] and len(got[1][0]) < 12
    assert sorted(got[2][0]) in ([(0, 0), (0, 4), (2, 2)], [(2, 2), (4, 0), (4, 4)]) and not got[2][1]
    assert len(got[3][0]) == 10 and not got[3][1]
    assert got[5] == (None, False) and got[6] == ([(0, 0), (5, 0), (5, 5)], False) and got[7] == (None, False) and got[8] == (None, False)


def inside(ring, x, y):
    return footprints.winding([(float(a), float(b)) for a, b in ring], x, y) != 0


@pytest.mark.parametrize("seed", range(6))
def test_outlines_hold_what_the_ring_goes_round(seed):
    """Random crossing rings: a place is inside the outlines (outer less inner) just where the ring goes round it."""
    rng = random.Random(seed)
    ring = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(9)]
    found = footprints.outlines(ring)
    for _ in range(400):
        x, y = rng.uniform(-1, 10) + 1e-4, rng.uniform(-1, 10) + 1e-4
        assert (sum(footprints.winding(r, x, y) for r in found) == 1) == inside(ring, x, y)


def spokes(rng, n):
    return [(r * math.cos(a), r * math.sin(a)) for a, r in ((2 * math.pi * k / n, rng.uniform(1, 9)) for k in range(n))]


def test_ears_fill_the_ring_and_nothing_else(spark):
    rng = random.Random(8)
    u = [(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)]
    begun_late = [(2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]  # a fan from its first corner would cover too much
    straight = [(0, 0), (1, 0), (2, 0), (2, 2), (1, 2), (0, 2), (0, 1)]
    shapes = [L, u, u[::-1], begun_late, straight, *(spokes(rng, n) for n in (3, 5, 9, 14, 30))]
    df = frame(spark, *shapes, [(0, 0), (1, 1)], None)
    got = df.select("id", rings.ears("ring").alias("t"), rings.area("ring").alias("area")).orderBy("id").collect()
    for shape, r in zip(shapes, got, strict=False):
        parts = [[(t[c].x, t[c].y) for c in "abc"] for t in r.t]
        assert abs(sum(footprints._area(p) for p in parts) - r.area) < 1e-6
        for p in parts:
            cx, cy = sum(x for x, _ in p) / 3 + 1e-7, sum(y for _, y in p) / 3 + 1e-7
            assert inside(shape, cx, cy)
        for _ in range(60):
            x, y = rng.uniform(-9, 10), rng.uniform(-9, 10)
            assert sum(inside(p, x, y) for p in parts) == inside(shape, x, y)
    assert got[-1].t == got[-2].t == []


def test_prism_over_a_concave_ring_is_closed(spark):
    """Each edge of its triangles is met once from either side."""
    row = frame(spark, L).select(F.explode(rings.extruded("ring", F.lit(0), F.lit(3))).alias("t")).collect()
    ways = {}
    for r in row:
        ps = [tuple(r.t[c]) for c in "abc"]
        for e in zip(ps, ps[1:] + ps[:1], strict=True):
            ways[e] = ways.get(e, 0) + 1
    assert all(n == 1 and ways.get((b, a)) == 1 for (a, b), n in ways.items())
