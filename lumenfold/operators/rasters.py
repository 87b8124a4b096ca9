"""Rasters as cell tables, and rays marched over them.

A raster tile is a row with its box and size; its values are rows (tile, rx, ry, value),
row 0 in the north. A point's cell is found by arithmetic, so a lookup is an
equi-join whatever the raster's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import half_up
from . import spatial


def cell_of(at: str, low: str, high: str, n: str, flip: bool = False) -> Column:
    """Number of the cell along one axis, clamped to the raster; flip: counted from the high end."""
    ratio = (F.col(high) - F.col(at)) / (F.col(high) - F.col(low)) if flip else (F.col(at) - F.col(low)) / (F.col(high) - F.col(low))
    return F.greatest(F.lit(0), F.least(F.floor(ratio * F.col(n)), F.col(n) - 1)).cast("int")


def tiles_by_cell(tiles: DataFrame, side: float) -> DataFrame:
    """__cx, __cy and __tiles: the tiles (in order) that meet each cell of that side."""
    n = lambda c: F.floor(F.col(c) / side).cast("bigint")
    cells = tiles.withColumn("__cx", F.explode(F.sequence(n("min_x"), n("max_x")))).withColumn("__cy", F.explode(F.sequence(n("min_y"), n("max_y"))))
    one = F.struct("tile", "min_x", "min_y", "max_x", "max_y", "width", "height")
    return cells.groupBy("__cx", "__cy").agg(F.array_sort(F.collect_list(one)).alias("__tiles"))


def sample(points: DataFrame, tiles: DataFrame, cells: DataFrame) -> DataFrame:
    """points (sx, sy) with the value of the nearest cell below them, null outside all tiles or without data.

    tiles (tile, min_x, min_y, max_x, max_y, width, height) are metadata rows; points meet
    them by cells as large as the largest tile, and where tiles overlap the first by tile
    counts. cells (tile, rx, ry, value) join by key. Every point keeps its row, repeated ones too.
    """
    side = tiles.agg(F.max(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))).first()[0] or 1.0
    n = lambda c: F.floor(F.col(c) / side).cast("bigint")
    near = points.withColumn("__cx", n("sx")).withColumn("__cy", n("sy")).join(spatial.small(tiles_by_cell(tiles, side)), ["__cx", "__cy"], "left")
    inside = lambda t: F.col("sx").between(t["min_x"], t["max_x"]) & F.col("sy").between(t["min_y"], t["max_y"])
    on = near.withColumn("__t", F.get(F.filter("__tiles", inside), F.lit(0))).select(*points.columns, "__t.*")
    on = on.withColumn("rx", cell_of("sx", "min_x", "max_x", "width")).withColumn("ry", cell_of("sy", "min_y", "max_y", "height", flip=True))
    return on.select(*points.columns, "tile", "rx", "ry").join(cells, ["tile", "rx", "ry"], "left").select(*points.columns, "value")


def march(rays: DataFrame, step: float, reach: float, after: int = 0) -> DataFrame:
    """rays (x, y, azimuth) with a row for each distance step, 2 step, ... up to reach, the first ``after`` of them left out: dist, sx, sy."""
    n = int(reach // step)
    turn = F.radians("azimuth")
    out = rays.withColumn("dist", F.explode(F.transform(F.sequence(F.lit(after + 1), F.lit(n)), lambda k: k * float(step))))
    return out.withColumn("sx", F.col("x") + F.sin(turn) * F.col("dist")).withColumn("sy", F.col("y") + F.cos(turn) * F.col("dist"))


def _within(cells: DataFrame, tiles: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The cells that points of a box (low x, low y, high x, high y) can lie in."""
    ends = tiles
    for name, at in zip(("lx", "ly", "hx", "hy"), box, strict=True):
        ends = ends.withColumn(f"__{name}", F.lit(float(at)))
    ends = ends.select(
        "tile", cell_of("__lx", "min_x", "max_x", "width").alias("__x0"), cell_of("__hx", "min_x", "max_x", "width").alias("__x1"),
        cell_of("__hy", "min_y", "max_y", "height", flip=True).alias("__y0"), cell_of("__ly", "min_y", "max_y", "height", flip=True).alias("__y1"),
    )
    on = cells.join(ends, "tile")
    return on.where(F.col("rx").between(F.col("__x0"), F.col("__x1")) & F.col("ry").between(F.col("__y0"), F.col("__y1"))).select(cells.columns)


def marched(rays: DataFrame, tiles: DataFrame, cells: DataFrame, step: float, reach: float, after: int = 0) -> DataFrame:
    """sample() of march() for rays (x, y, z, azimuth, altitude) above the horizon, without the steps at which they pass above every cell.

    Only cells of the rays' own surroundings take part; where they are few they come to the rays, and no step is moved.
    """
    up = rays.where("altitude > 0")
    lo_x, lo_y, hi_x, hi_y = up.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if lo_x is None or lo_y is None:
        return sample(march(up, step, reach, after), tiles, cells)
    far = reach + step
    near = spatial.cut(_within(cells, tiles, (lo_x - far, lo_y - far, hi_x + far, hi_y + far)))
    top = near.agg(F.max("value")).first()[0]
    low = F.col("dist") * F.tan(F.radians("altitude")) <= F.lit(top).cast("double") - F.col("z") + 1e-6
    return sample(march(spatial.dealt(up, spatial.RAYS), step, reach, after).where(low), tiles, spatial.small(near))


def first_blocked(blocked: Callable[[DataFrame, str], DataFrame], rays: DataFrame, tiles: DataFrame, cells: DataFrame, step: float, reach: float, key: str) -> DataFrame:
    """terrain_blocked() or vegetation_blocked() (blocked) of marched(). Keys are not null.

    Many rays are marched over a part of their reach first, and only those that are clear so far over the rest of it.
    """
    part = int(reach * spatial.NEARER // step)
    if not 0 < part < int(reach // step) or rays.limit(spatial.MANY + 1).count() <= spatial.MANY:
        return blocked(marched(rays, tiles, cells, step, reach), key)
    soon = spatial.cut(blocked(marched(rays, tiles, cells, step, part * step), key))
    rest = spatial.cut(rays.join(soon.select(key).hint("merge"), key, "left_anti"))
    return soon.unionByName(blocked(marched(rest, tiles, cells, step, reach, part), key))


def terrain_blocked(sampled: DataFrame, key: str, gate: float = 30.0) -> DataFrame:
    """key, distance, angle of the first step at which the ground stands above the ray (strictly).

    Only for 0 < altitude < gate; steps without data are passed over. Keys that are clear are left out.
    """
    clearance = F.col("value") - F.col("z")
    over = (F.col("altitude") > 0) & (F.col("altitude") < gate) & (clearance > 0) & (clearance > F.col("dist") * F.tan(F.radians("altitude")))
    hit = sampled.where(over).withColumn("angle", F.degrees(F.atan2(clearance, F.col("dist"))))
    return hit.groupBy(key).agg(F.min(F.struct("dist", "angle")).alias("b")).select(key, F.col("b.dist").alias("distance"), F.col("b.angle").alias("angle"))


def vegetation_blocked(sampled: DataFrame, key: str, min_clearance: float = 4.0) -> DataFrame:
    """key, distance, angle of the first step at which canopy at least min_clearance high reaches the sun (equality blocks)."""
    clearance = F.col("value") - F.col("z")
    angle = F.degrees(F.atan2(clearance, F.col("dist")))
    hit = sampled.where((F.col("altitude") > 0) & (clearance >= min_clearance)).withColumn("angle", angle).where(F.col("altitude") <= F.col("angle"))
    return hit.groupBy(key).agg(F.min(F.struct("dist", "angle")).alias("b")).select(key, F.col("b.dist").alias("distance"), half_up("b.angle", 3).alias("angle"))


def all_masks(rays: DataFrame, tiles: DataFrame, cells: DataFrame, obstacles: DataFrame, key: str, reach: float = 400.0) -> DataFrame:
    """key, terrain, buildings, vegetation, sun, sun_without_vegetation of rays (x, y, z, azimuth, altitude).

    A ray that the ground blocks is not tested further: its buildings and vegetation are false.
    """
    def of(hits: DataFrame, name: str) -> DataFrame:
        return hits.select(key).distinct().withColumn(name, F.lit(True))

    ground = of(terrain_blocked(marched(rays, tiles, cells, 5, 500), key), "__t")
    plants = of(vegetation_blocked(marched(rays, tiles, cells, 2, 120), key), "__g")
    walls = of(spatial.nearest_blocker(rays, obstacles, reach, key=key).where("blocked"), "__b")
    out = rays.select(key).join(ground, key, "left").join(walls, key, "left").join(plants, key, "left")
    t, b, g = (F.coalesce(c, F.lit(False)) for c in ("__t", "__b", "__g"))
    return out.select(
        key, t.alias("terrain"), (~t & b).alias("buildings"), (~t & g).alias("vegetation"), (~t & ~b & ~g).alias("sun"), (~t & ~b).alias("sun_without_vegetation")
    )


def horizon_profile(centres: DataFrame, tiles: DataFrame, cells: DataFrame, key: str, step: float, reach: float, refraction: float = 0.13) -> DataFrame:
    """key, az_bin, angle, distance, peak for each whole degree around each centre (lat, lon): the highest angle of the ground.

    Earth's curvature lowers distant ground, refraction raises it by its share.
    Directions without data have angle -90. Angles are rounded to three digits.
    """
    def around(lat: str, lon: str) -> DataFrame:
        return centres.select(key, lat, lon)

    rays = around("lat", "lon").withColumn("az_bin", F.explode(F.sequence(F.lit(0), F.lit(359))))
    rays = rays.withColumn("dist", F.explode(F.transform(F.sequence(F.lit(1), F.lit(int(reach // step))), lambda k: k * float(step))))
    rays = rays.withColumn("__p", geo.destination("lat", "lon", F.col("az_bin").cast("double"), "dist"))
    points = rays.select(key, "az_bin", "dist", F.col("__p.lon").alias("sx"), F.col("__p.lat").alias("sy"))
    own = sample(around("lat", "lon").select(key, F.col("lon").alias("sx"), F.col("lat").alias("sy")), tiles, cells).where("value is not null").select(key, F.col("value").alias("z0"))
    seen = sample(points, tiles, cells).join(own, key)
    height = F.col("value") - F.col("z0") - F.col("dist") * F.col("dist") / (2 * geo.EARTH_RADIUS) * (1 - refraction)
    angle = F.degrees(F.atan2(height, F.col("dist")))
    best = seen.withColumn("angle", angle).groupBy(key, "az_bin").agg(F.max(F.struct("angle", (-F.col("dist")).alias("near"), "value")).alias("b"))
    has = F.col("b.angle").isNotNull()
    return best.select(key, "az_bin", half_up(F.when(has, F.col("b.angle")).otherwise(-90.0), 3).alias("angle"), F.when(has, -F.col("b.near")).alias("distance"), F.col("b.value").alias("peak"))
