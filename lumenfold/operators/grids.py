"""Tiles, points and other generated grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import half_up

TILE = 250


def tile_id(e: Column, n: Column, size: int) -> Column:
    return F.concat(F.lit("e"), e.cast("bigint"), F.lit("_n"), n.cast("bigint"), F.lit(f"_s{size}"))


def region_tiles(regions: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles of the plane that meet each region's box (region, min_lon, min_lat, max_lon, max_lat).

    region, tile_id, min_e, min_n, max_e, max_n and the tile's box as lon0, lat0, lon1, lat1.
    The box's corners are projected, the area is aligned outwards to the tile size.
    """
    corners = regions
    for k, (lon, lat) in enumerate((("min_lon", "min_lat"), ("min_lon", "max_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"))):
        corners = corners.withColumn(f"c{k}", geo.to_plane(lon, lat))
    low = lambda a: F.floor(F.least(*(F.col(f"c{k}.{a}") for k in range(4))) / size)
    high = lambda a: F.ceil(F.greatest(*(F.col(f"c{k}.{a}") for k in range(4))) / size)
    cells = corners.select("region", "min_lon", "min_lat", "max_lon", "max_lat", low("e").alias("e0"), high("e").alias("e1"), low("n").alias("n0"), high("n").alias("n1"))
    cells = cells.withColumn("ce", F.explode(F.sequence(F.col("e0"), F.col("e1") - 1))).withColumn("cn", F.explode(F.sequence(F.col("n0"), F.col("n1") - 1)))
    cells = cells.withColumn("min_e", (F.col("ce") * size).cast("double")).withColumn("min_n", (F.col("cn") * size).cast("double"))
    cells = cells.withColumn("sw", geo.to_wgs84("min_e", "min_n")).withColumn("ne", geo.to_wgs84(F.col("min_e") + size, F.col("min_n") + size))
    tiles = cells.select(
        "region", tile_id(F.col("min_e"), F.col("min_n"), size).alias("tile_id"), "min_e", "min_n", (F.col("min_e") + size).alias("max_e"), (F.col("min_n") + size).alias("max_n"),
        F.least("sw.lon", "ne.lon").alias("lon0"), F.least("sw.lat", "ne.lat").alias("lat0"), F.greatest("sw.lon", "ne.lon").alias("lon1"), F.greatest("sw.lat", "ne.lat").alias("lat1"),
        "min_lon", "min_lat", "max_lon", "max_lat",
    )
    meets = (F.col("min_lon") <= F.col("lon1")) & (F.col("max_lon") >= F.col("lon0")) & (F.col("min_lat") <= F.col("lat1")) & (F.col("max_lat") >= F.col("lat0"))
    return tiles.where(meets).drop("min_lon", "min_lat", "max_lon", "max_lat")


def tile_points(tiles: DataFrame, step: float) -> DataFrame:
    """Centres of the grid cells in each tile (tile_id, min_e, min_n, max_e, max_n): tile_id, ix, iy, e, n.

    Cells are numbered over the whole plane; tiles are half-open, so neighbours share no point.
    """
    def numbers(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / step), F.ceil(F.col(hi) / step) - 1))

    cells = tiles.select("tile_id", "min_e", "min_n", "max_e", "max_n", numbers("min_e", "max_e").alias("ix")).withColumn("iy", numbers("min_n", "max_n"))
    at = cells.withColumn("e", F.col("ix") * step + step / 2).withColumn("n", F.col("iy") * step + step / 2)
    inside = (F.col("e") >= F.col("min_e")) & (F.col("e") < F.col("max_e")) & (F.col("n") >= F.col("min_n")) & (F.col("n") < F.col("max_n"))
    return at.where(inside).select("tile_id", "ix", "iy", "e", "n")


def with_wgs84(points: DataFrame) -> DataFrame:
    return points.withColumn("__g", geo.to_wgs84("e", "n")).withColumn("lat", half_up("__g.lat", 6)).withColumn("lon", half_up("__g.lon", 6)).drop("__g")


def degree_grid(boxes: DataFrame, metres: float) -> DataFrame:
    """Lattice over each box in degrees: row, col, lat, lon; the step in longitude follows the box's mid latitude."""
    mid = F.radians((F.col("min_lat") + F.col("max_lat")) / 2)
    dlat = F.lit(metres / geo.METRES_PER_DEGREE)
    dlon = metres / (geo.METRES_PER_DEGREE * F.greatest(F.cos(mid), F.lit(0.01)))
    steps = boxes.withColumn("dlat", dlat).withColumn("dlon", dlon)
    n = lambda a, d: F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(f"max_{a}") - F.col(f"min_{a}")) / F.col(d)).cast("bigint")))
    cells = steps.withColumn("row", n("lat", "dlat")).withColumn("col", n("lon", "dlon"))
    return cells.withColumn("lat", F.col("min_lat") + F.col("row") * F.col("dlat")).withColumn("lon", F.col("min_lon") + F.col("col") * F.col("dlon")).drop("dlat", "dlon")


def time_samples(days: DataFrame, step_minutes: int) -> DataFrame:
    """days (start, end: instants) with a row for each ts from start, before end."""
    n = F.ceil((F.unix_micros("end") - F.unix_micros("start")) / (step_minutes * 60_000_000.0)).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return days.withColumn("k", F.explode(steps)).withColumn("ts", F.timestamp_micros(F.unix_micros("start") + F.col("k").cast("bigint") * (step_minutes * 60_000_000)))


def outdoor_index(points: DataFrame, tile: str = "tile_id", indoor: str = "indoor") -> DataFrame:
    """points with outdoor_index: dense numbers from 0 of each tile's outdoor points by row and column, null indoors."""
    w = Window.partitionBy(tile, indoor).orderBy("iy", "ix")
    return points.withColumn("outdoor_index", F.when(~F.col(indoor), F.row_number().over(w) - 1))


#: Where a terrace may be: the spot itself, then 8 directions 4 m away, then 8 m.
CANDIDATES = ((0.0, 0.0), *((d, b * 45.0) for d in (4.0, 8.0) for b in range(8)))


def terrace_candidates(places: DataFrame) -> DataFrame:
    """places (lat, lon) with 17 rows each: candidate (order of preference), c_lat, c_lon."""
    spots = F.array(*(geo.offset("lat", "lon", d, b) for d, b in CANDIDATES))
    return places.select("*", F.posexplode(spots).alias("candidate", "__s")).withColumn("c_lat", F.col("__s.lat")).withColumn("c_lon", F.col("__s.lon")).drop("__s")


def probe_points(tiles: DataFrame) -> DataFrame:
    """A 3 x 3 pattern in each tile at 0.2, 0.5 and 0.8 of its sides: tile_id, i, j, e, n."""
    ratios = F.array(*map(F.lit, (0.2, 0.5, 0.8)))
    grid = tiles.select("*", F.posexplode(ratios).alias("i", "u")).select("*", F.posexplode(ratios).alias("j", "v"))
    return grid.select("tile_id", "i", "j", (F.col("min_e") + F.col("u") * (F.col("max_e") - F.col("min_e"))).alias("e"), (F.col("min_n") + F.col("v") * (F.col("max_n") - F.col("min_n"))).alias("n"))
