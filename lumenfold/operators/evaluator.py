"""Sunlight of many points at many instants in one plan.

Instants whose sun stands in the same angle bucket see the same, so each (point, bucket) is one ray,
evaluated once: the horizon first, then the ground, each on what is still clear, then buildings and
vegetation on what relief leaves. Verdicts are packed to bit masks by (tile, bucket), and only masks meet instants:
points times instants is never a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sun
from . import index, meshes, rasters
from .checks import cut

#: From rays (ray, x, y, z, azimuth, altitude) the ray of each one that is blocked; rows may repeat.
Evaluator = Callable[[DataFrame], DataFrame]

#: Bits of a word of a mask.
WORD = 32
MASKS = ("terrain", "buildings", "vegetation", "sun", "sun_without_vegetation")


def terrain(tiles: DataFrame, cells: DataFrame, step: float = 5.0, reach: float = 500.0) -> Evaluator:
    """The ground of rasters (see rasters.sample) marched over."""
    return lambda rays: rasters.first_blocked(rasters.terrain_blocked, rays, tiles, cells, step, reach, "ray").select("ray")


def vegetation(tiles: DataFrame, cells: DataFrame, step: float = 2.0, reach: float = 120.0) -> Evaluator:
    """The canopy of rasters marched over."""
    return lambda rays: rasters.first_blocked(rasters.vegetation_blocked, rays, tiles, cells, step, reach, "ray").select("ray")


def buildings(obstacles: DataFrame, mode: str = "prism", triangles: DataFrame | None = None, reach: float = 400.0) -> Evaluator:
    """Obstacles in one of the modes of meshes.building_blockers()."""
    return lambda rays: meshes.building_blockers(rays, obstacles, reach, mode, triangles, "ray").select("ray")


def bucket_rays(points: DataFrame, suns: DataFrame, resolution: float) -> DataFrame:
    """A ray (ray: struct<tile, az_b, alt_b, i>, x, y, z, azimuth, altitude) for each point (tile, i, x, y, z) and
    angle bucket that one of the tile's suns (tile, azimuth, altitude) stands in above the horizon; angles are the bucket's centre."""
    b = index.target_buckets(suns, resolution, ("tile",))
    ray = F.struct("tile", "az_b", "alt_b", "i").alias("ray")
    centre = lambda c: ((F.col(c) + 0.5) * resolution)
    return points.join(b, "tile").select(ray, "x", "y", "z", centre("az_b").alias("azimuth"), centre("alt_b").alias("altitude"))


def verdicts(
    rays: DataFrame, profile: DataFrame | None = None, ground: Evaluator | None = None, built: Evaluator | None = None, green: Evaluator | None = None, all_blockers: bool = False
) -> DataFrame:
    """ray and the booleans of MASKS for each ray (saved or cheap to make again), in the order of sun.verdict().

    profile: (az_bin, angle) of the horizon, 360 rows. A step that is None blocks nothing. Rays that the horizon
    blocks are not marched; rays that relief blocks meet neither buildings nor vegetation, unless all_blockers is set.
    """
    clear, hidden = rays, None
    if profile is not None:
        at = index.horizon_blocked(rays.withColumn("az_bin", sun.azimuth_bin("azimuth")), profile).where("blocked").select("ray")
        hidden, clear = at, clear.join(at.hint("merge"), "ray", "left_anti")
    if ground is not None:
        at = ground(clear).select("ray").distinct()
        hidden = at if hidden is None else hidden.unionByName(at)
    if hidden is not None:
        hidden = cut(hidden)  # used by all that follows: marched over once
    open_ = rays if all_blockers or hidden is None else rays.join(hidden.hint("merge"), "ray", "left_anti")
    out, flags = rays.select("ray"), []
    for name, blocked in (("terrain", hidden), ("buildings", built and built(open_).select("ray").distinct()), ("vegetation", green and green(open_).select("ray").distinct())):
        if blocked is None:
            flags.append(F.lit(False).alias(name))
            continue
        out = out.join(blocked.withColumn(f"__{name}", F.lit(True)).hint("merge"), "ray", "left")
        flags.append(F.coalesce(F.col(f"__{name}"), F.lit(False)).alias(name))
    t, b, g = (f for f in flags)
    return out.select("ray", *flags, (~t & ~b & ~g).alias("sun"), (~t & ~b).alias("sun_without_vegetation"))


def packed(flagged: DataFrame, words: DataFrame) -> DataFrame:
    """tile, az_b, alt_b and a mask for each of MASKS: bit i of the tile's points, in words of 32 bits, lowest first.

    words: (tile, words), the length of the tile's masks. Bits are united in each task before the shuffle; a
    group of the second step has one row for each 32 points of a tile.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("ray.i"), F.lit(WORD)).cast("int"))
    word = F.floor(F.col("ray.i") / WORD).cast("int").alias("word")
    united = flagged.groupBy("ray.tile", "ray.az_b", "ray.alt_b", word).agg(*(F.bit_or(F.when(F.col(m), bit).otherwise(F.lit(0).cast("bigint"))).alias(m) for m in MASKS))
    own = united.groupBy("tile", "az_b", "alt_b").agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct(*MASKS)))).alias("by"))
    full = lambda m: F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda k: F.coalesce(F.try_element_at("by", k)[m], F.lit(0).cast("bigint")))
    return own.join(words, "tile").select("tile", "az_b", "alt_b", *(full(m).alias(m) for m in MASKS))


def ones(mask: str | Column) -> Column:
    """Set bits of a mask."""
    return F.aggregate(mask, F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))


def frame_masks(points: DataFrame, suns: DataFrame, resolution: float = 0.75, **steps: object) -> DataFrame:
    """tile, frame, MASKS, sunny, sunny_without_vegetation for each sun (tile, frame, azimuth, altitude).

    points: tile, i (whole, from 0, dense or not), x, y, z. steps: as of verdicts(). With the sun at or below the horizon all
    masks are zero. Frames of tiles without points, and points whose i is null, are left out; of points of one i a bit is set if any is blocked or clear.
    """
    points = points.where("i is not null")
    rays = cut(bucket_rays(points, suns, resolution))
    words = points.groupBy("tile").agg((F.floor(F.max("i") / WORD) + 1).cast("int").alias("words"))
    masks = packed(verdicts(rays, **steps), words)
    at = suns.withColumn("az_b", sun.bucket("azimuth", resolution)).withColumn("alt_b", F.when(F.col("altitude") > 0, sun.bucket("altitude", resolution)))
    dark = F.array_repeat(F.lit(0).cast("bigint"), F.col("words"))
    out = at.select("tile", "frame", "az_b", "alt_b").join(words, "tile").join(masks, ["tile", "az_b", "alt_b"], "left")
    out = out.select("tile", "frame", *(F.coalesce(m, dark).alias(m) for m in MASKS))
    return out.withColumn("sunny", ones("sun")).withColumn("sunny_without_vegetation", ones("sun_without_vegetation"))
