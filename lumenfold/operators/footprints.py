"""Footprints of buildings made usable: crossings resolved, spiky outlines replaced by their hull."""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import rings
from ..functions.numbers import D, col
from . import spatial

#: A ring of at least so many corners, at least so many of them of at most so many degrees, that fills at most this share of
#: its hull is spiky. (Fixed values.)
SPIKY_CORNERS, SHARP_CORNERS, SHARP_DEGREES, SPIKY_SHARE = 10, 3, 16.0, 0.72

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
Point = tuple[float, float]


def crossings(points: list[Point]) -> list[list[Point]]:
    """Each edge of a closed ring as the points on it in order: its ends and where it meets another edge.

    Edges are swept by their least x, so only those whose ranges overlap are compared.
    """
    n = len(points)
    cuts: list[set[Point]] = [{points[k], points[(k + 1) % n]} for k in range(n)]
    ends = [(points[k], points[(k + 1) % n]) for k in range(n)]
    order, open_ = sorted(range(n), key=lambda k: min(ends[k][0][0], ends[k][1][0])), []
    for k in order:
        (ax, ay), (bx, by) = ends[k]
        open_ = [m for m in open_ if max(ends[m][0][0], ends[m][1][0]) >= min(ax, bx) - 1e-9]
        for m in open_:
            (cx, cy), (dx, dy) = ends[m]
            ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
            det = ux * vy - uy * vx
            if abs(det) > 1e-12:
                s, t = ((cx - ax) * vy - (cy - ay) * vx) / det, ((cx - ax) * uy - (cy - ay) * ux) / det
                if -1e-9 <= s <= 1 + 1e-9 and -1e-9 <= t <= 1 + 1e-9:
                    at = (round(ax + s * ux, 9), round(ay + s * uy, 9))
                    cuts[k].add(at)
                    cuts[m].add(at)
                continue
            for i, j in ((k, m), (m, k)):  # parallel: ends that lie on the other edge
                (px, py), (qx, qy) = ends[i]
                for x, y in ends[j]:
                    length = (qx - px) ** 2 + (qy - py) ** 2
                    along = ((x - px) * (qx - px) + (y - py) * (qy - py)) / length
                    if abs((qx - px) * (y - py) - (qy - py) * (x - px)) <= 1e-9 * max(1.0, length) and 0 <= along <= 1:
                        cuts[i].add((x, y))
        open_.append(k)
    out = []
    for k, ((ax, ay), (bx, by)) in enumerate(ends):
        near = sorted(cuts[k], key=lambda p: (p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay))
        out.append([near[0], *(q for p, q in zip(near, near[1:], strict=False) if q != p)])
    return out


def winding(points: list[Point], x: float, y: float) -> int:
    """How often the closed ring goes round a place that is not on it."""
    turns = 0
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        if (ay <= y) != (by <= y):
            left = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            turns += (by > ay) and left > 0
            turns -= (by < ay) and left < 0
    return turns


def outlines(points: list[Point]) -> list[list[Point]]:
    """The anticlockwise outer and clockwise inner rings of what a closed ring goes round, by its edges between inside and outside.

    Where several meet in a point, the sharpest left turn goes on, so parts that touch in a point are rings of their own.
    """
    points = [(round(x, 9), round(y, 9)) for x, y in points]
    pieces = {tuple(sorted((a, b))) for line in crossings(points) for a, b in zip(line, line[1:], strict=False) if a != b}
    after: dict[Point, list[Point]] = defaultdict(list)
    for a, b in sorted(pieces):
        mx, my, ux, uy = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, b[0] - a[0], b[1] - a[1]
        off = 1e-6 * min(1.0, 1 / max(math.hypot(ux, uy), 1e-12))
        left, right = (winding(points, mx - s * uy * off, my + s * ux * off) != 0 for s in (1, -1))
        if left != right:
            start, end = (a, b) if left else (b, a)
            after[start].append(end)
    out = []
    while any(after.values()):
        start = min(p for p, ends in after.items() if ends)
        ring, here, way = [start], start, None
        while True:
            ends = after[here]
            if not ends:
                break
            if way is not None:
                ends.sort(key=lambda q: (math.atan2(q[1] - here[1], q[0] - here[0]) - way + math.pi - 1e-9) % (2 * math.pi))
            to = ends.pop()
            way, here = math.atan2(to[1] - here[1], to[0] - here[0]), to
            if here == start:
                out.append(ring)
                break
            ring.append(here)
    return out


def _area(ring: list[Point]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def largest(points: list[Point]) -> list[Point] | None:
    """Of a ring's outlines the one of the most corners, then the largest area, then the first; null if it has none of three."""
    found = [r for r in outlines(points) if len(r) >= 3]
    return max(found, key=lambda r: (len(r), round(_area(r), 9)), default=None)


@pandas_udf(RING)
def _united(ring: pd.Series) -> pd.Series:
    def one(r: list | None) -> list | None:
        got = None if r is None else largest([(p["x"], p["y"]) for p in r])
        return None if got is None else [{"x": x, "y": y} for x, y in got]

    return ring.map(one)


def normalised(df: DataFrame, ring: D = "ring") -> DataFrame:
    """df with footprint and used_hull for a ring (array<struct<x, y>>; null or under three different points: null, false).

    Points that repeat one to the millimetre go. A ring that crosses itself becomes the largest() of its outlines or, if that
    is not simple either, its hull. A spiky one becomes its hull. Only rings that cross themselves reach Python.
    """
    fit = F.transform(col(ring), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    out = spatial.dealt(df, spatial.RINGS).withColumn("__r", rings.without_repeats(rings.first_of_each_place(fit)))
    out = out.withColumn("__r", F.when(F.size("__r") >= 3, F.col("__r"))).withColumn("__ok", F.when(F.col("__r").isNotNull(), rings.is_simple("__r")))
    out = out.withColumn("__u", _united(F.when(~F.col("__ok"), F.col("__r"))))
    good = F.col("__u").isNotNull() & rings.is_simple("__u")
    out = out.withColumn("__p", F.when(F.col("__ok"), F.col("__r")).when(good, F.col("__u")).otherwise(rings.hull("__r"))).withColumn("__h", rings.hull("__p"))
    whole = rings.area("__h")
    share = F.when(whole > 0, rings.area("__p") / whole).otherwise(1.0)
    spiky = (F.size("__p") >= SPIKY_CORNERS) & (share <= SPIKY_SHARE) & (rings.sharp_corners("__p", SHARP_DEGREES) >= SHARP_CORNERS) & (F.size("__h") >= 3)
    used = F.coalesce((~F.col("__ok") & ~F.coalesce(good, F.lit(False))) | spiky, F.lit(False))
    flat = F.size("__p") >= 3
    return out.withColumn("footprint", F.when(flat, F.when(spiky, F.col("__h")).otherwise(F.col("__p")))).withColumn("used_hull", used).drop("__r", "__ok", "__u", "__p", "__h")
