"""The composed evaluator and detailed buildings over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sun
from ..operators import evaluator, meshes
from ..sources.tables import LAT, LON, Tables
from . import angles, shade
from .registry import query

_RESOLUTION, _REACH = 10.0, 300.0


def _triangles(t: Tables) -> DataFrame:
    """Hipped roofs over five of six obstacles; the others have no mesh."""
    return t.obstacles().where("id % 6 <> 0").select("id", F.explode(meshes.pyramid()).alias("t")).select("id", "t.*")


_PRISM_HITS = """rd AS (SELECT *, sin(radians(azimuth)) AS dx, cos(radians(azimuth)) AS dy FROM rays WHERE altitude > 0),
sl AS (SELECT r.*, o.id, o.max_z, o.min_x, o.min_y, o.max_x, o.max_y, o.min_z,
  CASE WHEN abs(dx) < 1e-9 THEN CASE WHEN x BETWEEN min_x AND max_x THEN -1e300 ELSE 1e300 END ELSE least((min_x - x) / dx, (max_x - x) / dx) END AS nx,
  CASE WHEN abs(dx) < 1e-9 THEN CASE WHEN x BETWEEN min_x AND max_x THEN 1e300 ELSE -1e300 END ELSE greatest((min_x - x) / dx, (max_x - x) / dx) END AS fx,
  CASE WHEN abs(dy) < 1e-9 THEN CASE WHEN y BETWEEN min_y AND max_y THEN -1e300 ELSE 1e300 END ELSE least((min_y - y) / dy, (max_y - y) / dy) END AS ny,
  CASE WHEN abs(dy) < 1e-9 THEN CASE WHEN y BETWEEN min_y AND max_y THEN 1e300 ELSE -1e300 END ELSE greatest((min_y - y) / dy, (max_y - y) / dy) END AS fy
  FROM rd r, obstacles o WHERE o.max_z > r.z),
hits AS (SELECT *, greatest(0, nx, ny) AS distance, degrees(atan2(max_z - z, greatest(1, greatest(0, nx, ny)))) AS angle FROM sl
  WHERE greatest(0, nx, ny) <= least(fx, fy) AND greatest(0, nx, ny) <= 300 AND altitude <= degrees(atan2(max_z - z, greatest(1, greatest(0, nx, ny)))))"""

#: Every hit with each side of its roof, by Moller and Trumbore's formulas.
_MESH = """sides AS (SELECT h.ray, h.id, h.x, h.y, h.z, cos(radians(altitude)) AS flat, sin(radians(azimuth)) * cos(radians(altitude)) AS vx, cos(radians(azimuth)) * cos(radians(altitude)) AS vy, sin(radians(altitude)) AS vz,
  CASE k WHEN 0 THEN min_x WHEN 1 THEN max_x WHEN 2 THEN max_x ELSE min_x END AS ax, CASE k WHEN 0 THEN min_y WHEN 1 THEN min_y WHEN 2 THEN max_y ELSE max_y END AS ay, min_z AS az,
  CASE k WHEN 0 THEN max_x WHEN 1 THEN max_x WHEN 2 THEN min_x ELSE min_x END AS bx, CASE k WHEN 0 THEN min_y WHEN 1 THEN max_y WHEN 2 THEN max_y ELSE min_y END AS "by",
  (min_x + max_x) / 2 AS px, (min_y + max_y) / 2 AS py, max_z AS pz FROM hits h, range(4) s(k) WHERE id % 6 <> 0),
ed AS (SELECT *, bx - ax AS ux, "by" - ay AS uy, 0e0 AS uz, px - ax AS wx, py - ay AS wy, pz - az AS wz, x - ax AS sx, y - ay AS sy, z - az AS sz FROM sides),
hm AS (SELECT *, vy * wz - vz * wy AS hx, vz * wx - vx * wz AS hy, vx * wy - vy * wx AS hz, sy * uz - sz * uy AS qx, sz * ux - sx * uz AS qy, sx * uy - sy * ux AS qz FROM ed),
dd AS (SELECT *, ux * hx + uy * hy + uz * hz AS det FROM hm),
uv AS (SELECT *, (sx * hx + sy * hy + sz * hz) / det AS u, (vx * qx + vy * qy + vz * qz) / det AS v, (wx * qx + wy * qy + wz * qz) / det AS t FROM dd WHERE abs(det) >= 1e-9),
mesh AS (SELECT ray, id, min(t * flat) AS distance FROM uv WHERE u BETWEEN 0 AND 1 AND v >= 0 AND u + v <= 1 AND t > 1e-9 AND t * flat <= 300 GROUP BY ray, id)"""


def _probes(t: Tables) -> DataFrame:
    """Rays from every probe in twelve directions, the sun low to high."""
    k = F.col("probe")
    out = t.probes().select("probe", (k * 9.7 % 990 + 4).alias("x"), (k * 7.3 % 790 + 5).alias("y"), F.lit(1.5).alias("z"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("d"))
    return out.select((k * 12 + F.col("d")).alias("ray"), "x", "y", "z", (F.col("d") * 30.0 + k % 30).alias("azimuth"), (3.0 + (k * 12 + F.col("d")) % 40).alias("altitude"))


_PROBES = "rays AS (SELECT s_suppkey * 12 + d AS ray, s_suppkey * 9.7e0 % 990e0 + 4e0 AS x, s_suppkey * 7.3e0 % 790e0 + 5e0 AS y, 1.5e0 AS z, d * 30e0 + s_suppkey % 30 AS azimuth, 3e0 + (s_suppkey * 12 + d) % 40 AS altitude FROM supplier, range(12) r(d))"


@query("shd14_mesh_hits", f"WITH {_PROBES}, {_PRISM_HITS}, {_MESH} SELECT ray, id, floor(distance * 1e3 + 0.5) / 1e3 AS distance FROM mesh", "obstacles")
def _(t: Tables) -> DataFrame:
    """Where rays meet the meshes of the buildings whose prisms block them."""
    return meshes.hits_by_shape(_probes(t), t.obstacles(), _triangles(t), _REACH, "ray")


def _mode_sql(near: float, steps: int) -> str:
    return f"""WITH {_PROBES}, {_PRISM_HITS}, {_MESH}, rk AS (SELECT *, row_number() OVER (PARTITION BY ray ORDER BY distance, id) AS rank FROM hits),
  ok AS (SELECT ray, rank, id, distance, angle FROM rk WHERE rank <= {steps + 2} AND (angle - altitude > {near} OR rank = {steps + 2} OR id % 6 = 0 OR (ray, id) IN (SELECT (ray, id) FROM mesh))),
  b AS (SELECT ray, min((rank, id, distance, angle)) AS b FROM ok GROUP BY ray)
  SELECT ray, b[2] AS blocker, floor(b[3] * 1e3 + 0.5) / 1e3 AS distance, floor(b[4] * 1e3 + 0.5) / 1e3 AS angle FROM b"""


@query("udf04_two_level", _mode_sql(2.0, 3), "obstacles")
def _(t: Tables) -> DataFrame:
    """Blockers that stand close to the sun's height are confirmed by their mesh, three times at most."""
    return meshes.building_blockers(_probes(t), t.obstacles(), _REACH, "two-level", _triangles(t), "ray")


@query("udf04_detailed", _mode_sql(90.0, 32), "obstacles")
def _(t: Tables) -> DataFrame:
    """All blockers are confirmed by their mesh."""
    return meshes.building_blockers(_probes(t), t.obstacles(), _REACH, "detailed", _triangles(t), "ray")


def _points(t: Tables) -> DataFrame:
    """Ten tiles of the suppliers; a point's number is its place in the tile."""
    k = F.col("probe")
    return t.probes().select((k % 10).cast("int").alias("tile"), F.floor(k / 10).cast("int").alias("i"), (k * 19.7 % 1790 + 7).alias("x"), (k * 7.3 % 390 + 3).alias("y"), F.lit(2.0).alias("z"))


def _suns(t: Tables) -> DataFrame:
    """The sun over each tile at every hour in which an event fell."""
    hours = t.events().select(F.date_trunc("hour", "ts").alias("frame")).distinct()
    at = hours.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("s", sun.sun_position("frame", F.lit(LAT) + F.col("tile") * 0.01, F.lit(LON)))
    return at.select("tile", "frame", "s.azimuth", "s.altitude")


_FRAMES = f"""fr AS (SELECT DISTINCT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS frame FROM events),
s0 AS (SELECT frame, CAST(tile AS INTEGER) AS tile, epoch_us(frame) / 86400000000e0 - 10957.5e0 AS d, radians({LAT}e0 + tile * 0.01e0) AS phi FROM fr, range(10) r(tile)),
s1 AS (SELECT *, radians(357.5291e0 + 0.98560028e0 * d) AS m FROM s0),
s2 AS (SELECT *, m + radians(1.9148e0 * sin(m) + 0.02e0 * sin(2 * m) + 0.0003e0 * sin(3 * m)) + radians(102.9372e0) + pi() AS l FROM s1),
s3 AS (SELECT *, asin(greatest(-1e0, least(1e0, sin(radians(23.4397e0)) * sin(l)))) AS dec, atan2(sin(l) * cos(radians(23.4397e0)), cos(l)) AS ra FROM s2),
s4 AS (SELECT *, radians(280.16e0 + 360.9856235e0 * d) + radians({LON}e0) - ra AS h FROM s3),
s5 AS (SELECT tile, frame, degrees(atan2(sin(h), cos(h) * sin(phi) - tan(dec) * cos(phi))) + 180 AS a, degrees(asin(greatest(-1e0, least(1e0, sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(h))))) AS altitude FROM s4),
suns AS (SELECT tile, frame, CASE WHEN altitude > 0 THEN CAST(floor((CASE WHEN a >= 360 THEN a - 360 WHEN a < 0 THEN a + 360 ELSE a END) / {_RESOLUTION}) AS INTEGER) END AS az_b, CASE WHEN altitude > 0 THEN CAST(floor(altitude / {_RESOLUTION}) AS INTEGER) END AS alt_b FROM s5),
pts AS (SELECT CAST(s_suppkey % 10 AS INTEGER) AS tile, CAST(s_suppkey // 10 AS INTEGER) AS i, s_suppkey * 19.7e0 % 1790e0 + 7e0 AS x, s_suppkey * 7.3e0 % 390e0 + 3e0 AS y, 2e0 AS z FROM supplier),
bk AS (SELECT DISTINCT tile, az_b, alt_b FROM suns WHERE alt_b IS NOT NULL),
rays AS (SELECT row_number() OVER () AS probe, row_number() OVER () AS ray, tile, az_b, alt_b, i, x, y, z, (az_b + 0.5e0) * {_RESOLUTION} AS azimuth, (alt_b + 0.5e0) * {_RESOLUTION} AS altitude FROM pts JOIN bk USING (tile))"""


def _masks_sql(blocked: str, horizon: bool, all_blockers: bool = False) -> str:
    hidden = "ray IN (SELECT probe FROM tr)" + (" OR coalesce(altitude <= (SELECT angle FROM horizon WHERE az_bin = CAST(floor(azimuth + 0.5) AS INTEGER) % 360), false)" if horizon else "")
    open_ = "true" if all_blockers else "NOT t"
    masks = ", ".join(f"string_agg({m}, ':' ORDER BY w) AS {m}" for m in evaluator.MASKS)
    words = ", ".join(f"CAST(bit_or(CASE WHEN {m} THEN CAST(1 AS BIGINT) << (i % 32) ELSE 0 END) AS VARCHAR) AS {m}" for m in evaluator.MASKS)
    return f"""WITH {shade._SURFACE}, {_FRAMES}, {shade._march_sql(5, 500)}, {shade._TERRAIN}, {shade._PLANTS}, {_PRISM_HITS}, {blocked},
  f0 AS (SELECT *, {hidden} AS t, ray IN (SELECT ray FROM bl) AS b, ray IN (SELECT probe FROM vg) AS g FROM rays),
  f AS (SELECT *, t AS terrain, {open_} AND b AS buildings, {open_} AND g AS vegetation, NOT t AND NOT b AND NOT g AS sun, NOT t AND NOT b AS sun_without_vegetation FROM f0),
  u AS (SELECT tile, az_b, alt_b, i // 32 AS w, {words} FROM f GROUP BY ALL),
  p AS (SELECT tile, az_b, alt_b, {masks} FROM u GROUP BY ALL),
  n AS (SELECT tile, az_b, alt_b, count(*) FILTER (sun) AS sunny, count(*) FILTER (sun_without_vegetation) AS sunny_without_vegetation FROM f GROUP BY ALL),
  z AS (SELECT tile, string_agg('0', ':') AS dark FROM (SELECT DISTINCT tile, i // 32 FROM pts) GROUP BY tile)
  SELECT tile, frame, {", ".join(f"coalesce({m}, dark) AS {m}" for m in evaluator.MASKS)}, coalesce(sunny, 0) AS sunny, coalesce(sunny_without_vegetation, 0) AS sunny_without_vegetation
  FROM suns JOIN z USING (tile) LEFT JOIN p USING (tile, az_b, alt_b) LEFT JOIN n USING (tile, az_b, alt_b)"""


_PRISMS = "bl AS (SELECT DISTINCT ray FROM hits)"
_MESHES = f"""{_MESH}, rk AS (SELECT *, row_number() OVER (PARTITION BY ray ORDER BY distance, id) AS rank FROM hits),
bl AS (SELECT DISTINCT ray FROM rk WHERE rank <= 34 AND (rank = 34 OR id % 6 = 0 OR (ray, id) IN (SELECT (ray, id) FROM mesh)))"""


def _shown(masks: DataFrame) -> DataFrame:
    text = lambda m: F.array_join(F.transform(m, lambda w: w.cast("string")), ":").alias(m)
    return masks.select("tile", "frame", *(text(m) for m in evaluator.MASKS), "sunny", "sunny_without_vegetation")


@query("udf03_batch_masks", _masks_sql(_PRISMS, True), "obstacles", "horizon")
def _(t: Tables) -> DataFrame:
    """All five masks of every tile at every hour: horizon (a degree without an angle hides nothing), ground, buildings as prisms, vegetation."""
    surface = shade._surface(t)
    return _shown(evaluator.frame_masks(
        _points(t), _suns(t), _RESOLUTION, profile=t.horizon(), ground=evaluator.terrain(*surface), built=evaluator.buildings(t.obstacles(), reach=_REACH), green=evaluator.vegetation(*surface),
    ))


@query("udf02_detailed_masks", _masks_sql(_MESHES, False), "obstacles")
def _(t: Tables) -> DataFrame:
    """The same without a horizon profile, every building confirmed by its mesh."""
    surface = shade._surface(t)
    return _shown(evaluator.frame_masks(
        _points(t), _suns(t), _RESOLUTION, ground=evaluator.terrain(*surface), built=evaluator.buildings(t.obstacles(), "detailed", _triangles(t), _REACH), green=evaluator.vegetation(*surface),
    ))


@query("udf01_all_blockers", _masks_sql(_PRISMS, False, True), "obstacles")
def _(t: Tables) -> DataFrame:
    """Buildings and vegetation are evaluated behind relief too."""
    surface = shade._surface(t)
    return _shown(evaluator.frame_masks(
        _points(t), _suns(t), _RESOLUTION, ground=evaluator.terrain(*surface), built=evaluator.buildings(t.obstacles(), reach=_REACH), green=evaluator.vegetation(*surface), all_blockers=True,
    ))
