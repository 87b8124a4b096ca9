"""Polygons as arrays of struct<x, y>, and rays against them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import D, bound, col


def edges(ring: D) -> Column:
    """array<struct<a, b>>: each point with the next, the last with the first."""
    r = col(ring)
    following = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.zip_with(r, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def area(ring: D) -> Column:
    """Unsigned area by the shoelace formula."""
    return bound(col(ring), lambda r: F.abs(F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2)


def contains(ring: D, x: D, y: D) -> Column:
    """Even-odd rule; horizontal edges do not count."""
    x, y = col(x), col(y)

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dy = b["y"] - a["y"]
        at = (b["x"] - a["x"]) * (y - a["y"]) / dy + a["x"]
        return (F.abs(dy) >= 1e-12) & ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.size(F.filter(edges(ring), crossed)) % 2 == 1


def on_edge(ring: D, x: D, y: D) -> Column:
    """Whether the point lies on an edge of the closed ring."""
    x, y = col(x), col(y)

    def met(e: Column) -> Column:
        a, b = e["a"], e["b"]
        within = x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return within & ((b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"]))

    return F.exists(edges(ring), met)


def inside(ring: D, x: D, y: D) -> Column:
    """Whether the point lies within the ring, its edges left out.

    A sloping edge's height at x is taken from its higher end, and both sides of the edge and the edge itself are told by that one number.
    """
    x, y = col(x), col(y)

    def at(e: Column) -> Column:
        top, foot = F.when(e["a"]["y"] >= e["b"]["y"], e["a"]).otherwise(e["b"]), F.when(e["a"]["y"] >= e["b"]["y"], e["b"]).otherwise(e["a"])
        return (foot["y"] - top["y"]) * (x - top["x"]) / (foot["x"] - top["x"]) + top["y"]

    def met(e: Column) -> Column:
        a, b = e["a"], e["b"]
        wall = (x == a["x"]) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return F.when(a["x"] == b["x"], wall).otherwise(x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & (y == at(e)))

    def above(e: Column) -> Column:
        return F.when((e["a"]["x"] > x) != (e["b"]["x"] > x), y < at(e)).otherwise(F.lit(False))

    return (F.size(F.filter(edges(ring), above)) % 2 == 1) & ~F.exists(edges(ring), met)


def ray_to_segment(x: D, y: D, dx: D, dy: D, ax: D, ay: D, bx: D, by: D) -> Column:
    """Distance along the ray to the segment, null where they do not meet."""
    x, y, dx, dy, ax, ay, bx, by = map(col, (x, y, dx, dy, ax, ay, bx, by))
    sx, sy = bx - ax, by - ay
    across = dx * sy - dy * sx
    t = ((ax - x) * sy - (ay - y) * sx) / across
    u = ((ax - x) * dy - (ay - y) * dx) / across
    return F.when((F.abs(across) >= 1e-9) & (t >= 0) & (u >= 0) & (u <= 1), t)


def ray_to_ring(ring: D, x: D, y: D, dx: D, dy: D) -> Column:
    """Distance along the ray to the polygon: 0 inside, null where it is missed or has fewer than 3 points."""
    hits = F.transform(edges(ring), lambda e: ray_to_segment(x, y, dx, dy, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    return F.when(F.size(col(ring)) >= 3, F.when(contains(ring, x, y), F.lit(0.0)).otherwise(F.array_min(F.filter(hits, lambda h: h.isNotNull()))))


def ray_to_box(x: D, y: D, dx: D, dy: D, min_x: D, min_y: D, max_x: D, max_y: D) -> Column:
    """Distance along the ray to an upright box: 0 inside, null where it is missed."""
    x, y, dx, dy, min_x, min_y, max_x, max_y = map(col, (x, y, dx, dy, min_x, min_y, max_x, max_y))
    far = F.lit(float("inf"))

    def slab(p: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        flat = F.abs(d) < 1e-9
        within = p.between(lo, hi)
        near_ = F.when(flat, F.when(within, -far).otherwise(far)).otherwise(F.least((lo - p) / d, (hi - p) / d))
        far_ = F.when(flat, F.when(within, far).otherwise(-far)).otherwise(F.greatest((lo - p) / d, (hi - p) / d))
        return near_, far_

    (near_x, far_x), (near_y, far_y) = slab(x, dx, min_x, max_x), slab(y, dy, min_y, max_y)
    enter, leave = F.greatest(F.lit(0.0), near_x, near_y), F.least(far_x, far_y)
    return F.when(enter <= leave, enter)


def ray_to_triangle(o: tuple, d: tuple, a: tuple, b: tuple, c: tuple) -> Column:
    """Distance along the ray (o, d) to a triangle, each a triple of columns (Moeller and Trumbore 1997); null where missed."""
    o, d, a, b, c = ([col(v) for v in p] for p in (o, d, a, b, c))

    def minus(p: list, q: list) -> list:
        return [p[i] - q[i] for i in range(3)]

    def cross(p: list, q: list) -> list:
        return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]

    def dot(p: list, q: list) -> Column:
        return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]

    ab, ac = minus(b, a), minus(c, a)
    h = cross(d, ac)
    det = dot(ab, h)
    s = minus(o, a)
    q = cross(s, ab)
    u, v, t = dot(s, h) / det, dot(d, q) / det, dot(ac, q) / det
    return F.when((F.abs(det) > 1e-9) & (u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1) & (t > 1e-9), t)


def without_repeats(ring: D, apart: float = 1e-6) -> Column:
    """The ring without points that lie on the one before them (the first: on the last)."""
    def kept(r: Column, p: Column, i: Column) -> Column:
        before = F.element_at(r, F.when(i == 0, F.size(r)).otherwise(i))
        return (F.size(r) == 1) | (F.abs(p["x"] - before["x"]) > apart) | (F.abs(p["y"] - before["y"]) > apart)

    return bound(col(ring), lambda r: F.filter(r, lambda p, i: kept(r, p, i)))


def without_collinear(ring: D) -> Column:
    """The closed ring without points on the straight line between their neighbours."""
    r = col(ring)

    def kept(p: Column, i: Column) -> Column:
        before = F.element_at(r, F.when(i == 0, F.size(r)).otherwise(i))
        after = F.element_at(r, F.when(i == F.size(r) - 1, 1).otherwise(i + 2))
        return F.abs((p["x"] - before["x"]) * (after["y"] - p["y"]) - (p["y"] - before["y"]) * (after["x"] - p["x"])) > 1e-12

    return F.filter(r, kept)


def _turn(a: Column, b: Column, c: Column) -> Column:
    """Positive where a, b, c turn left."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def hull(points: D) -> Column:
    """The convex hull of array<struct<x, y>>, anticlockwise from the lowest (x, y), without points on its edges.

    Two monotone chains over the sorted distinct points. A chain is convex, so the last place from
    which the next point turns left is where it is continued.
    """

    def chain(p: Column) -> Column:
        def add(stack: Column, q: Column) -> Column:
            left = F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(stack))), lambda k: (F.size(stack) >= 2) & (_turn(F.get(stack, k - 2), F.get(stack, k - 1), q) > 0))
            return F.concat(F.slice(stack, 1, F.coalesce(F.array_max(left), F.least(F.lit(1), F.size(stack)))), F.array(q))

        return F.aggregate(p, F.slice(p, 1, 0), add)

    def both(p: Column) -> Column:
        half = lambda q: bound(chain(q), lambda c: F.slice(c, 1, F.size(c) - 1))
        return F.when(F.size(p) < 3, p).otherwise(F.concat(half(p), half(F.reverse(p))))

    return bound(F.array_sort(F.array_distinct(col(points))), both)


def is_simple(ring: D) -> Column:
    """Whether no two edges of the closed ring that are not neighbours cross or touch."""

    def cross(e: Column, f: Column) -> Column:
        a, b = _turn(e["a"], e["b"], f["a"]), _turn(e["a"], e["b"], f["b"])
        c, d = _turn(f["a"], f["b"], e["a"]), _turn(f["a"], f["b"], e["b"])
        apart = (F.greatest(e["a"]["x"], e["b"]["x"]) < F.least(f["a"]["x"], f["b"]["x"])) | (F.greatest(f["a"]["x"], f["b"]["x"]) < F.least(e["a"]["x"], e["b"]["x"]))
        apart = apart | (F.greatest(e["a"]["y"], e["b"]["y"]) < F.least(f["a"]["y"], f["b"]["y"])) | (F.greatest(f["a"]["y"], f["b"]["y"]) < F.least(e["a"]["y"], e["b"]["y"]))
        return ~apart & (F.signum(a) * F.signum(b) <= 0) & (F.signum(c) * F.signum(d) <= 0)

    def none_meet(es: Column) -> Column:
        n = F.size(es)
        pairs = F.transform(es, lambda e, i: F.exists(F.filter(es, lambda f, j: (j > i + 1) & ~((i == 0) & (j == n - 1))), lambda f: cross(e, f)))
        return ~F.exists(pairs, lambda x: x)

    return bound(edges(ring), none_meet)


def clip(ring: D, min_x: D, min_y: D, max_x: D, max_y: D) -> Column:
    """The part of a ring within an upright box (Sutherland and Hodgman 1974): the area is right for every simple ring."""

    none = F.array().cast("array<struct<x:double,y:double>>")

    def half(r: Column, axis: str, limit: Column, sign: int) -> Column:
        other = "y" if axis == "x" else "x"
        inside = lambda p: p[axis] * sign <= limit * sign

        def part(e: Column) -> Column:
            a, b = e["a"], e["b"]
            at = a[other] + (b[other] - a[other]) * (limit - a[axis]) / (b[axis] - a[axis])
            met = {axis: limit.cast("double"), other: at}
            point = F.struct(met["x"].alias("x"), met["y"].alias("y"))
            return F.concat(F.when(inside(a) != inside(b), F.array(point)).otherwise(none), F.when(inside(b), F.array(b)).otherwise(none))

        return bound(r, lambda q: F.flatten(F.transform(edges(q), part)))

    out = F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    for axis, limit, sign in (("x", col(max_x), 1), ("x", col(min_x), -1), ("y", col(max_y), 1), ("y", col(min_y), -1)):
        out = half(out, axis, limit, sign)
    return out


def anticlockwise(ring: D) -> Column:
    """The ring turned round if it runs clockwise."""
    twice = lambda r: F.aggregate(edges(r), F.lit(0.0), lambda n, e: n + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return bound(col(ring), lambda r: F.when(twice(r) < 0, F.reverse(r)).otherwise(r))


def ears(ring: D) -> Column:
    """array<struct<a, b, c>> of anticlockwise triangles that fill a simple ring, convex or not (null or under three points: none).

    In each step of a fold the first ear goes: a corner that turns left and whose triangle holds no other point. Corners on a straight line go
    without a triangle; where rounding leaves no ear, the corner that turns left the most goes.
    """
    point = "struct<x:double,y:double>"
    none = F.array().cast(f"array<struct<a:{point},b:{point},c:{point}>>")

    def corner(r: Column, k: Column) -> tuple[Column, Column, Column]:
        n = F.size(r)
        return F.get(r, F.pmod(k - 1, n)), F.get(r, k), F.get(r, F.pmod(k + 1, n))

    def clear(r: Column, k: Column) -> Column:
        a, b, c = corner(r, k)
        within = lambda p: (p != a) & (p != b) & (p != c) & (_turn(a, b, p) >= 0) & (_turn(b, c, p) >= 0) & (_turn(c, a, p) >= 0)
        turn = _turn(a, b, c)
        return (turn == 0) | ((turn > 0) & ~F.exists(r, within))

    def step(acc: Column, _: Column) -> Column:
        def cut(r: Column) -> Column:
            places = F.sequence(F.lit(0), F.size(r) - 1)
            most = F.array_max(F.transform(places, lambda k: F.struct(_turn(*corner(r, k)).alias("t"), (-k).alias("k"))))
            return bound(F.coalesce(F.get(F.filter(places, lambda k: clear(r, k)), F.lit(0)), -most["k"]), lambda k: took(r, k))

        def took(r: Column, k: Column) -> Column:
            a, b, c = corner(r, k)
            one = F.when(_turn(a, b, c) > 0, F.array(F.struct(a.alias("a"), b.alias("b"), c.alias("c")))).otherwise(none)
            return F.struct(F.filter(r, lambda _, i: i != k).alias("rest"), F.concat(acc["done"], one).alias("done"))

        return F.when(F.size(acc["rest"]) < 3, acc).otherwise(bound(acc["rest"], cut))

    def fold(r: Column) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(r) - 2))
        return F.aggregate(steps, F.struct(r.alias("rest"), none.alias("done")), step, lambda s: s["done"])

    plain = F.transform(without_repeats(ring, 0.0), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.coalesce(bound(anticlockwise(plain), fold), none)


def first_of_each_place(ring: D, digits: int = 3) -> Column:
    """The ring's points but those that equal an earlier one to so many digits."""
    k = float(10**digits)
    place = lambda p: F.struct(F.floor(p["x"] * k + 0.5).alias("x"), F.floor(p["y"] * k + 0.5).alias("y"))
    return bound(col(ring), lambda r: bound(F.transform(r, place), lambda ps: F.filter(r, lambda p, i: F.array_position(ps, place(p)) == i + 1)))


def sharp_corners(ring: D, degrees: float) -> Column:
    """How many corners of the closed ring are of at most so many degrees, whichever way they turn."""
    def angle(r: Column, k: Column) -> Column:
        n = F.size(r)
        a, b, c = F.get(r, F.pmod(k - 1, n)), F.get(r, k), F.get(r, F.pmod(k + 1, n))
        u, v = ((p["x"] - b["x"], p["y"] - b["y"]) for p in (a, c))
        long = F.hypot(*u) * F.hypot(*v)
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (u[0] * v[0] + u[1] * v[1]) / long))))

    return bound(col(ring), lambda r: F.size(F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda k: angle(r, k) <= degrees)))


def extruded(ring: D, low: D, high: D) -> Column:
    """array<struct<part, a, b, c>> of a prism's triangles, points as struct<x, y, z>: the roof cut into
    ears (so footprints may be concave), the floor the other way round, and two for each wall."""
    z0, z1 = col(low), col(high)
    up = lambda p, z: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.cast("double").alias("z"))

    def made(r: Column) -> Column:
        tri = lambda part, a, b, c: F.struct(F.lit(part).alias("part"), a.alias("a"), b.alias("b"), c.alias("c"))
        both = lambda t: F.array(tri("roof", up(t["a"], z1), up(t["b"], z1), up(t["c"], z1)), tri("floor", up(t["a"], z0), up(t["c"], z0), up(t["b"], z0)))
        walls = F.flatten(F.transform(edges(r), lambda e: F.array(tri("wall", up(e["a"], z0), up(e["b"], z0), up(e["b"], z1)), tri("wall", up(e["a"], z0), up(e["b"], z1), up(e["a"], z1)))))
        return F.concat(F.flatten(F.transform(ears(r), both)), walls)

    return F.when(F.size(col(ring)) >= 3, bound(col(ring), made))


def triangle_area(t: Column) -> Column:
    u, v = ({k: t[p][k] - t["a"][k] for k in "xyz"} for p in "bc")
    n = [u["y"] * v["z"] - u["z"] * v["y"], u["z"] * v["x"] - u["x"] * v["z"], u["x"] * v["y"] - u["y"] * v["x"]]
    return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
