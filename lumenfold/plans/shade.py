"""Rasters: lookups, ray marches and horizon profiles over a surface made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators import index, rasters, spatial
from ..sources.tables import Tables
from .registry import query

#: One raster, 100 cells of 20 m wide and as high as the table of parts is long; a cell's height comes from the part of its number.
_W, _SIDE = 100, 20.0


def _surface(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    cells = t.read("part").select(F.lit(0).alias("tile"), (k % _W).cast("int").alias("rx"), F.floor(k / _W).cast("int").alias("ry"), F.col("p_size").cast("double").alias("value"))
    rows = cells.agg((F.max("ry") + 1).alias("height"))
    tile = rows.select(F.lit(0).alias("tile"), F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"), F.lit(_W * _SIDE).alias("max_x"), (F.col("height") * _SIDE).alias("max_y"), F.lit(_W).alias("width"), "height")
    return tile, cells


_SURFACE = f"cells AS (SELECT CAST(p_partkey % {_W} AS BIGINT) AS rx, CAST(p_partkey // {_W} AS BIGINT) AS ry, CAST(p_size AS DOUBLE) AS value FROM part), hh AS (SELECT max(ry) + 1 AS h FROM cells)"
_H = "(SELECT h FROM hh)"
_AT = f"greatest(0, least({_W - 1}, CAST(floor(sx / {_SIDE}) AS BIGINT))) AS rx, greatest(0, least({_H} - 1, CAST(floor(({_H} * {_SIDE} - sy) / {_SIDE}) AS BIGINT))) AS ry"
_IN = f"sx BETWEEN 0 AND {_W * _SIDE} AND sy BETWEEN 0 AND {_H} * {_SIDE}"


def _rays(t: Tables) -> DataFrame:
    k = F.col("probe")
    return t.probes().select("probe", (k % 90 * 20.0 + 7).alias("x"), (k % 20 * 20.0 + 3).alias("y"), F.lit(3.0).alias("z"), "azimuth", (1 + k % 28).cast("double").alias("altitude"))


_RAYS = "rays AS (SELECT probe, probe % 90 * 20e0 + 7 AS x, probe % 20 * 20e0 + 3 AS y, 3e0 AS z, azimuth, CAST(1 + probe % 28 AS DOUBLE) AS altitude FROM probes)"


def _march_sql(step: int, reach: int) -> str:
    return f"""m AS (SELECT probe, z, altitude, CAST(d AS DOUBLE) AS dist, x + sin(radians(azimuth)) * d AS sx, y + cos(radians(azimuth)) * d AS sy FROM rays, range({step}, {reach + 1}, {step}) r(d)),
  v AS (SELECT m.*, value FROM (SELECT *, {_AT} FROM m WHERE {_IN}) m LEFT JOIN cells USING (rx, ry))"""


@query("join06_raster_lookup", f"WITH {_SURFACE}, p AS (SELECT probe, x AS sx, y AS sy FROM probes) SELECT probe, CASE WHEN inside THEN value END AS value FROM (SELECT probe, {_AT}, {_IN} AS inside FROM p) LEFT JOIN cells USING (rx, ry)", "probes")
def _(t: Tables) -> DataFrame:
    tile, cells = _surface(t)
    return rasters.sample(t.probes().select("probe", F.col("x").alias("sx"), F.col("y").alias("sy")), tile, cells).select("probe", "value")


@query("shd08_terrain_march", f"WITH {_SURFACE}, {_RAYS}, {_march_sql(5, 500)}, h AS (SELECT probe, min(dist) AS distance FROM v WHERE altitude > 0 AND altitude < 30 AND value > z AND value - z > dist * tan(radians(altitude)) GROUP BY probe) SELECT * FROM h", "probes")
def _(t: Tables) -> DataFrame:
    seen = rasters.marched(_rays(t), *_surface(t), 5, 500)
    return rasters.terrain_blocked(seen, "probe").select("probe", "distance")


@query("shd09_vegetation_march", f"WITH {_SURFACE}, {_RAYS}, {_march_sql(2, 120)} SELECT probe, min(dist) AS distance FROM v WHERE altitude > 0 AND value - z >= 4 AND altitude <= degrees(atan2(value - z, dist)) GROUP BY probe", "probes")
def _(t: Tables) -> DataFrame:
    seen = rasters.marched(_rays(t), *_surface(t), 2, 120)
    return rasters.vegetation_blocked(seen, "probe").select("probe", "distance")


_TERRAIN = "tr AS (SELECT DISTINCT probe FROM v WHERE altitude > 0 AND altitude < 30 AND value > z AND value - z > dist * tan(radians(altitude)))"
_PLANTS = f"m2 AS (SELECT probe, z, altitude, CAST(d AS DOUBLE) AS dist, x + sin(radians(azimuth)) * d AS sx, y + cos(radians(azimuth)) * d AS sy FROM rays, range(2, 121, 2) r(d)), v2 AS (SELECT m.*, value FROM (SELECT *, {_AT} FROM m2 WHERE {_IN}) m LEFT JOIN cells USING (rx, ry)), vg AS (SELECT DISTINCT probe FROM v2 WHERE altitude > 0 AND value - z >= 4 AND altitude <= degrees(atan2(value - z, dist)))"
#: The slab test of every ray with every box: where it enters (0 inside) and leaves.
_BLOCKED = """rd AS (SELECT *, sin(radians(azimuth)) AS dx, cos(radians(azimuth)) AS dy FROM rays WHERE altitude > 0), sl AS (SELECT r.probe, r.z, r.altitude, o.max_z,
  CASE WHEN abs(dx) < 1e-9 THEN CASE WHEN x BETWEEN min_x AND max_x THEN -1e300 ELSE 1e300 END ELSE least((min_x - x) / dx, (max_x - x) / dx) END AS nx, CASE WHEN abs(dx) < 1e-9 THEN CASE WHEN x BETWEEN min_x AND max_x THEN 1e300 ELSE -1e300 END ELSE greatest((min_x - x) / dx, (max_x - x) / dx) END AS fx,
  CASE WHEN abs(dy) < 1e-9 THEN CASE WHEN y BETWEEN min_y AND max_y THEN -1e300 ELSE 1e300 END ELSE least((min_y - y) / dy, (max_y - y) / dy) END AS ny, CASE WHEN abs(dy) < 1e-9 THEN CASE WHEN y BETWEEN min_y AND max_y THEN 1e300 ELSE -1e300 END ELSE greatest((min_y - y) / dy, (max_y - y) / dy) END AS fy
  FROM rd r, obstacles o WHERE o.max_z > r.z), bl AS (SELECT DISTINCT probe FROM sl WHERE greatest(0, nx, ny) <= least(fx, fy) AND greatest(0, nx, ny) <= 300 AND altitude <= degrees(atan2(max_z - z, greatest(1, greatest(0, nx, ny)))))"""


@query("shd17_all_masks", f"""WITH {_SURFACE}, {_RAYS}, {_march_sql(5, 500)}, {_TERRAIN}, {_PLANTS}, {_BLOCKED}, f AS (SELECT probe, probe IN (SELECT probe FROM tr) AS t, probe IN (SELECT probe FROM bl) AS b, probe IN (SELECT probe FROM vg) AS g FROM rays)
  SELECT probe, t AS terrain, NOT t AND b AS buildings, NOT t AND g AS vegetation, NOT t AND NOT b AND NOT g AS sun, NOT t AND NOT b AS sun_without_vegetation FROM f""", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    """Verdicts of every evaluator in their order: terrain first, which settles the others, then buildings and vegetation."""
    rays, (tile, cells) = _rays(t), _surface(t)
    return rasters.all_masks(rays, tile, cells, t.obstacles(), "probe", reach=300.0)


@query("shd06_horizon_profile", """WITH c AS (SELECT p % 40 AS rx, p // 40 AS ry, 400e0 + 30 * max(p_size) AS value FROM (SELECT (p_partkey * 8 + r) % 1600 AS p, p_size FROM part, range(8) q(r)) GROUP BY 1, 2),
  o AS (SELECT id, 46.5e0 + id * 0.01e0 AS lat, 6.6e0 AS lon FROM range(2) i(id)), ct AS (SELECT *, greatest(0, least(39, CAST(floor((lon - 6.5e0) / (6.7e0 - 6.5e0) * 40) AS BIGINT))) AS rx, greatest(0, least(39, CAST(floor((46.6e0 - lat) / (46.6e0 - 46.4e0) * 40) AS BIGINT))) AS ry FROM o),
  own AS (SELECT id, value AS z0 FROM ct JOIN c USING (rx, ry)), st AS (SELECT id, az, CAST(d AS DOUBLE) AS dist, radians(lat) AS phi, radians(lon) AS lam, radians(CAST(az AS DOUBLE)) AS turn, d / 6371000e0 AS arc FROM o, range(360) a(az), range(250, 6001, 250) b(d)),
  s2 AS (SELECT *, asin(sin(phi) * cos(arc) + cos(phi) * sin(arc) * cos(turn)) AS to_ FROM st), pt AS (SELECT id, az, dist, degrees(to_) AS sy, degrees(lam + atan2(sin(turn) * sin(arc) * cos(phi), cos(arc) - sin(phi) * sin(to_))) AS sx FROM s2),
  v AS (SELECT pt.id, az, dist, value, value - z0 - dist * dist / (2 * 6371000e0) * (1 - 0.13e0) AS h FROM (SELECT *, greatest(0, least(39, CAST(floor((sx - 6.5e0) / (6.7e0 - 6.5e0) * 40) AS BIGINT))) AS rx, greatest(0, least(39, CAST(floor((46.6e0 - sy) / (46.6e0 - 46.4e0) * 40) AS BIGINT))) AS ry FROM pt WHERE sx BETWEEN 6.5e0 AND 6.7e0 AND sy BETWEEN 46.4e0 AND 46.6e0) pt JOIN c USING (rx, ry) JOIN own ON own.id = pt.id),
  b AS (SELECT id, az, max((degrees(atan2(h, dist)), -dist, value)) AS m FROM v GROUP BY id, az)
  SELECT id, CAST(az AS INTEGER) AS az_bin, floor(m[1] * 1e3 + 0.5) / 1e3 AS angle, -m[2] AS distance, m[3] AS peak FROM b""")
def _(t: Tables) -> DataFrame:
    """Profiles around two centres over a surface in degrees."""
    tile = t.spark.range(1).select(F.lit(0).alias("tile"), F.lit(6.5).alias("min_x"), F.lit(46.4).alias("min_y"), F.lit(6.7).alias("max_x"), F.lit(46.6).alias("max_y"), F.lit(40).alias("width"), F.lit(40).alias("height"))
    p = F.col("p")
    parts = t.read("part").select("p_size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: (F.col("p_partkey") * 8 + r) % 1600)).alias("p"))
    cells = parts.groupBy(F.lit(0).alias("tile"), (p % 40).cast("int").alias("rx"), F.floor(p / 40).cast("int").alias("ry")).agg((400.0 + 30 * F.max("p_size")).alias("value"))
    centres = t.spark.range(2).select("id", (46.5 + F.col("id") * 0.01).alias("lat"), F.lit(6.6).alias("lon"))
    return rasters.horizon_profile(centres, tile, cells, "id", 250.0, 6000.0)


@query("shd20_profile_choice", """WITH s AS (SELECT event_id, CAST(event_id % 360 AS INTEGER) AS az_bin, value AS altitude FROM events), j AS (SELECT s.az_bin % 9 AS tile, altitude <= h.angle AS a, altitude <= h.angle - 1 AS b FROM s JOIN horizon h USING (az_bin)) SELECT CAST(tile AS INTEGER) AS tile, count(*) AS n, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS differing, CASE WHEN sum(CASE WHEN a <> b THEN 1 ELSE 0 END) <= 2 OR sum(CASE WHEN a <> b THEN 1e0 ELSE 0e0 END) / count(*) <= 0.005 THEN 'shared' ELSE 'local' END AS strategy FROM j GROUP BY tile""", "horizon")
def _(t: Tables) -> DataFrame:
    s = t.events().select("event_id", (F.col("event_id") % 360).cast("int").alias("az_bin"), F.col("value").alias("altitude"))
    j = index.horizon_blocked(s, t.horizon()).withColumn("other", F.col("altitude") <= F.col("angle") - 1)
    g = j.groupBy((F.col("az_bin") % 9).alias("tile")).agg(F.count("*").alias("n"), F.count_if(F.col("blocked") != F.col("other")).alias("differing"))
    return g.withColumn("strategy", F.when((F.col("differing") <= 2) | (F.col("differing") / F.col("n") <= 0.005), "shared").otherwise("local"))


@query("shd21_macro_cells", "SELECT id, CAST(floor(center_x / 2000) * 2000 + 1000 AS BIGINT) AS cx, CAST(floor(center_y / 500) * 500 + 250 AS BIGINT) AS cy FROM obstacles", "obstacles")
def _(t: Tables) -> DataFrame:
    mid = lambda c, s: (F.floor(F.col(c) / s) * s + s // 2).alias
    return t.obstacles().select("id", mid("center_x", 2000)("cx"), mid("center_y", 500)("cy"))


@query("shd15_missing_mesh", "SELECT id, CASE WHEN id % 6 = 0 THEN true ELSE id % 2 = 0 END AS blocked FROM obstacles", "obstacles")
def _(t: Tables) -> DataFrame:
    hit = F.when(F.col("id") % 6 != 0, F.col("id") % 2 == 0)
    return t.obstacles().select("id", F.coalesce(hit, F.lit(True)).alias("blocked"))


@query("shd18_indoor", "SELECT p.probe, count(o.id) > 0 AS indoor FROM probes p LEFT JOIN obstacles o ON p.x BETWEEN o.min_x AND o.max_x AND p.y BETWEEN o.min_y AND o.max_y AND o.max_z > p.z GROUP BY p.probe", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    cells = spatial.obstacle_cells(t.obstacles())
    p = t.probes().withColumn("cx", F.floor(F.col("x") / spatial.CELL).cast("int")).withColumn("cy", F.floor(F.col("y") / spatial.CELL).cast("int"))
    inside = p.join(cells, ["cx", "cy"]).where("x between min_x and max_x and y between min_y and max_y and max_z > z").select("probe").distinct().withColumn("indoor", F.lit(True))
    return t.probes().select("probe").join(inside, "probe", "left").select("probe", F.coalesce("indoor", F.lit(False)).alias("indoor"))


@query("shd19_bias_clamp", "SELECT event_id, greatest(-20e0, least(20e0, value * 5 - 25)) AS bias FROM events")
def _(t: Tables) -> DataFrame:
    from ..functions.numbers import clamp

    return t.events().select("event_id", clamp(F.col("value") * 5 - 25, -20.0, 20.0).alias("bias"))


@query("shd22_wall_triangles", """WITH p AS (SELECT id, max_x - min_x AS w, max_y - min_y AS d, max_z AS h FROM obstacles) SELECT id, 'floor' AS part, CAST(2 AS BIGINT) AS n, floor(w * d * 1e6 + 0.5) / 1e6 AS area, 0e0 AS top FROM p UNION ALL SELECT id, 'roof', 2, floor(w * d * 1e6 + 0.5) / 1e6, h FROM p UNION ALL SELECT id, 'wall', 8, floor(2 * (w + d) * h * 1e6 + 0.5) / 1e6, h FROM p""", "obstacles")
def _(t: Tables) -> DataFrame:
    from ..functions import rings

    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(pt("min_x", "min_y"), pt("max_x", "min_y"), pt("max_x", "max_y"), pt("min_x", "max_y"))
    o = t.obstacles().select("id", F.explode(rings.extruded(ring, "min_z", "max_z")).alias("t"))
    top = F.greatest("t.a.z", "t.b.z", "t.c.z")
    return o.groupBy("id", "t.part").agg(F.count("*").alias("n"), half_up(F.sum(rings.triangle_area(F.col("t"))), 6).alias("area"), F.max(top).alias("top"))
