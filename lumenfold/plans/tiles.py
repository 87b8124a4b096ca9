"""Coordinates, tiles, points and samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, zones
from ..functions.numbers import half_up
from ..operators import grids
from ..sources.tables import Tables
from .registry import query

_TO_PLANE = f"""g0 AS (SELECT *, radians(lat) AS p, radians(lon) AS q FROM pts), g1 AS (SELECT *, {geo.WGS_A}e0 / sqrt(1 - {geo.WGS_E2}e0 * sin(p) * sin(p)) AS nn FROM g0),
g2 AS (SELECT *, nn * cos(p) * cos(q) - {geo.SHIFT[0]}e0 AS x, nn * cos(p) * sin(q) - {geo.SHIFT[1]}e0 AS y, nn * (1 - {geo.WGS_E2}e0) * sin(p) - {geo.SHIFT[2]}e0 AS z FROM g1),
g3 AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(y, x) AS lam, {geo.BESSEL_A * math.sqrt(1 - geo.BESSEL_E2)!r}::DOUBLE AS bb FROM g2), g4 AS (SELECT *, atan2(z * {geo.BESSEL_A}e0, r * bb) AS th FROM g3),
g5 AS (SELECT *, atan2(z + {geo.BESSEL_E2 / (1 - geo.BESSEL_E2)!r}::DOUBLE * bb * pow(sin(th), 3), r - {geo.BESSEL_E2}e0 * {geo.BESSEL_A}e0 * pow(cos(th), 3)) AS phi FROM g4),
g6 AS (SELECT *, ln(tan(pi() / 4 + phi / 2)) - {geo.E / 2!r}::DOUBLE * ln((1 + {geo.E!r}::DOUBLE * sin(phi)) / (1 - {geo.E!r}::DOUBLE * sin(phi))) AS s FROM g5),
g7 AS (SELECT *, 2 * atan(exp({geo.K!r}::DOUBLE + {geo.ALPHA!r}::DOUBLE * s)) - pi() / 2 AS b, (lam - {geo.ORIGIN_LON!r}::DOUBLE) * {geo.ALPHA!r}::DOUBLE AS tn FROM g6),
g8 AS (SELECT *, asin({math.cos(geo.B0)!r}::DOUBLE * sin(b) - {math.sin(geo.B0)!r}::DOUBLE * cos(b) * cos(tn)) AS b2, atan2(cos(b) * sin(tn), {math.sin(geo.B0)!r}::DOUBLE * sin(b) + {math.cos(geo.B0)!r}::DOUBLE * cos(b) * cos(tn)) AS l2 FROM g7),
plane AS (SELECT * EXCLUDE (p, q, nn, x, y, z, r, lam, bb, th, phi, s, b, tn, b2, l2), 2600000e0 + {geo.SPHERE_R!r}::DOUBLE * l2 AS e, 1200000e0 + {geo.SPHERE_R!r}::DOUBLE * ln(tan(pi() / 4 + b2 / 2)) AS n FROM g8)"""


@query("mth01_to_plane", f"WITH pts AS (SELECT id, lon, lat FROM places), {_TO_PLANE} SELECT id, floor(e * 1e3 + 0.5) / 1e3 AS e, floor(n * 1e3 + 0.5) / 1e3 AS n FROM plane", "places")
def _(t: Tables) -> DataFrame:
    return t.places().select("id", geo.to_plane("lon", "lat").alias("p")).select("id", half_up("p.e", 3).alias("e"), half_up("p.n", 3).alias("n"))


@query("mth02_to_wgs84_round_trip", "SELECT id, floor(lon * 1e6 + 0.5) / 1e6 AS lon, floor(lat * 1e6 + 0.5) / 1e6 AS lat FROM (SELECT id, lon, lat FROM places)", "places")
def _(t: Tables) -> DataFrame:
    there = t.places().select("id", geo.to_plane("lon", "lat").alias("p"))
    return there.select("id", geo.to_wgs84("p.e", "p.n").alias("g")).select("id", half_up("g.lon", 6).alias("lon"), half_up("g.lat", 6).alias("lat"))


@query("mth03_to_wgs84_fast", """WITH a AS (SELECT p_partkey AS id, (p_partkey % 997) / 1e4 AS y, (p_partkey % 613) / 1e4 AS x FROM part)
  SELECT id, floor((2.6779094e0 + 4.728982e0 * y + 0.791484e0 * y * x + 0.1306e0 * y * x * x - 0.0436e0 * y * y * y) * 100 / 36 * 1e7 + 0.5) / 1e7 AS lon,
  floor((16.9023892e0 + 3.238272e0 * x - 0.270978e0 * y * y - 0.002528e0 * x * x - 0.0447e0 * y * y * x - 0.0140e0 * x * x * x) * 100 / 36 * 1e7 + 0.5) / 1e7 AS lat FROM a""")
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    p = t.read("part").select(k.alias("id"), geo.to_wgs84_fast(geo.FALSE_E + (k % 997) * 100.0, geo.FALSE_N + (k % 613) * 100.0).alias("g"))
    return p.select("id", half_up("g.lon", 7).alias("lon"), half_up("g.lat", 7).alias("lat"))


@query("mth04_offset", "SELECT id, floor((lat + cos(radians(id % 360)) * (id % 50) / 111320e0) * 1e8 + 0.5) / 1e8 AS lat2, floor((lon + sin(radians(id % 360)) * (id % 50) / (111320e0 * greatest(cos(radians(lat)), 0.01e0))) * 1e8 + 0.5) / 1e8 AS lon2 FROM places", "places")
def _(t: Tables) -> DataFrame:
    o = geo.offset("lat", "lon", F.col("id") % 50, F.col("id") % 360)
    return t.places().select("id", o.alias("o")).select("id", half_up("o.lat", 8).alias("lat2"), half_up("o.lon", 8).alias("lon2"))


@query("mth05_box_around", "SELECT id, floor((lon - (1 + id % 9) / (111.32e0 * greatest(cos(radians(lat)), 0.01e0))) * 1e8 + 0.5) / 1e8 AS min_lon, floor((lat + (1 + id % 9) / 111.32e0) * 1e8 + 0.5) / 1e8 AS max_lat FROM places", "places")
def _(t: Tables) -> DataFrame:
    b = t.places().select("id", geo.box_around("lon", "lat", 1 + F.col("id") % 9).alias("b"))
    return b.select("id", half_up("b.min_lon", 8).alias("min_lon"), half_up("b.max_lat", 8).alias("max_lat"))


@query("mth07_half_up", "SELECT event_id, floor(value * 1e3 + 0.5) / 1e3 AS r3, floor(-value + 0.5) AS r0 FROM events")
def _(t: Tables) -> DataFrame:
    return t.events().select("event_id", half_up("value", 3).alias("r3"), half_up(-F.col("value")).alias("r0"))


@query("mth15_overlap_area", "SELECT id, region, greatest(0e0, least(max_lon, lon + 0.02e0) - greatest(min_lon, lon - 0.02e0)) * greatest(0e0, least(max_lat, lat + 0.02e0) - greatest(min_lat, lat - 0.02e0)) > 0 AS meets FROM places, regions_", "places", "regions_")
def _(t: Tables) -> DataFrame:
    b = t.places().select("id", *((F.col(a) + s).alias(f"q_{m}_{a}") for a in ("lon", "lat") for m, s in (("min", -0.02), ("max", 0.02))))
    return b.join(F.broadcast(t.regions()), how="cross").select("id", "region", (geo.overlap_area("q_", "") > 0).alias("meets"))


@query("mth16_haversine", "SELECT id, floor(2 * 6371000e0 * asin(sqrt(pow(sin(radians(46.52e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(46.52e0)) * pow(sin(radians(6.63e0 - lon) / 2), 2))) * 1e4 + 0.5) / 1e4 AS metres FROM places", "places")
def _(t: Tables) -> DataFrame:
    return t.places().select("id", half_up(geo.haversine("lat", "lon", F.lit(46.52), F.lit(6.63)), 4).alias("metres"))


@query("mth17_bi_affine", "SELECT id, floor(((1 - u) * (1 - v) * 1 + u * (1 - v) * 5 + (1 - u) * v * 7 + u * v * 20) * 1e9 + 0.5) / 1e9 AS z, floor(156543.03392804097e0 * cos(radians(lat)) / pow(2, 10 + id % 8) * 1e9 + 0.5) / 1e9 AS mpp FROM (SELECT id, lat, (id % 10) / 10e0 AS u, (id % 7) / 7e0 AS v FROM places)", "places")
def _(t: Tables) -> DataFrame:
    u, v = (F.col("id") % 10) / 10.0, (F.col("id") % 7) / 7.0
    z = geo.bi_affine(u, v, *(F.lit(float(c)) for c in (1, 5, 7, 20)))
    return t.places().select("id", half_up(z, 9).alias("z"), half_up(geo.metres_per_pixel("lat", 10 + F.col("id") % 8), 9).alias("mpp"))


@query("shd07_destination", """SELECT id, floor(degrees(asin(s)) * 1e8 + 0.5) / 1e8 AS lat2, floor(degrees(radians(lon) + atan2(sin(b) * sin(a) * cos(p), cos(a) - sin(p) * s)) * 1e8 + 0.5) / 1e8 AS lon2
  FROM (SELECT *, sin(p) * cos(a) + cos(p) * sin(a) * cos(b) AS s FROM (SELECT id, lat, lon, radians(lat) AS p, radians(id % 360) AS b, (id % 1000) * 100 / 6371000e0 AS a FROM places))""", "places")
def _(t: Tables) -> DataFrame:
    d = geo.destination("lat", "lon", F.col("id") % 360, (F.col("id") % 1000) * 100)
    return t.places().select("id", d.alias("d")).select("id", half_up("d.lat", 8).alias("lat2"), half_up("d.lon", 8).alias("lon2"))


_TILE_SQL = """tl AS (SELECT 'e' || (2538000 + 250 * i) || '_n1152000_s250' AS tile_id, 2538000e0 + 250 * i AS min_e, 1152000e0 AS min_n FROM range(4) r(i))"""


def _tiles(t: Tables) -> DataFrame:
    e = F.col("id") * 250 + 2_538_000
    low = t.spark.range(4).select(grids.tile_id(e, F.lit(1_152_000), 250).alias("tile_id"), e.cast("double").alias("min_e"), F.lit(1_152_000.0).alias("min_n"))
    return low.withColumn("max_e", F.col("min_e") + 250).withColumn("max_n", F.col("min_n") + 250)


@query("prj05_tile_points", f"""WITH {_TILE_SQL} SELECT tile_id, CAST(min_e / 20 AS BIGINT) + i AS ix, CAST(min_n / 20 AS BIGINT) + j AS iy FROM tl, range(-1, 14) a(i), range(-1, 14) b(j)
  WHERE (CAST(min_e / 20 AS BIGINT) + i) * 20 + 10 >= min_e AND (CAST(min_e / 20 AS BIGINT) + i) * 20 + 10 < min_e + 250 AND (CAST(min_n / 20 AS BIGINT) + j) * 20 + 10 >= min_n AND (CAST(min_n / 20 AS BIGINT) + j) * 20 + 10 < min_n + 250""")
def _(t: Tables) -> DataFrame:
    return grids.tile_points(_tiles(t), 20).select("tile_id", "ix", "iy")


@query("prj04_region_tiles")
def _(t: Tables) -> DataFrame:
    return grids.region_tiles(t.regions())


@query("prj06_degree_grid", """WITH s AS (SELECT *, 500 / 111320e0 AS dlat, 500 / (111320e0 * greatest(cos(radians((min_lat + max_lat) / 2)), 0.01e0)) AS dlon FROM regions_)
  SELECT region, r AS row, c AS col, floor((min_lat + r * dlat) * 1e8 + 0.5) / 1e8 AS lat, floor((min_lon + c * dlon) * 1e8 + 0.5) / 1e8 AS lon FROM s, range(0, 200) a(r), range(0, 200) b(c) WHERE r <= floor((max_lat - min_lat) / dlat) AND c <= floor((max_lon - min_lon) / dlon)""", "regions_")
def _(t: Tables) -> DataFrame:
    return grids.degree_grid(t.regions(), 500).select("region", "row", "col", half_up("lat", 8).alias("lat"), half_up("lon", 8).alias("lon"))


@query("prj07_time_samples", "SELECT day, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT day, unnest(generate_series(CAST(day AS TIMESTAMP) + INTERVAL 6 HOUR, CAST(day AS TIMESTAMP) + INTERVAL 21 HOUR - INTERVAL 1 SECOND, INTERVAL 15 MINUTE)) AS ts FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)) GROUP BY day")
def _(t: Tables) -> DataFrame:
    days = t.events().select(F.to_date("ts").alias("day")).distinct()
    span = days.withColumn("start", F.col("day").cast("timestamp") + F.expr("interval 6 hours")).withColumn("end", F.col("day").cast("timestamp") + F.expr("interval 21 hours"))
    return grids.time_samples(span, 15).groupBy("day").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("prj08_day_list", "SELECT region, unnest(generate_series(lo, lo + INTERVAL 6 DAY, INTERVAL 1 DAY))::DATE AS day FROM (SELECT region, min(day) AS lo FROM runs GROUP BY region)", "runs")
def _(t: Tables) -> DataFrame:
    lo = t.runs().groupBy("region").agg(F.min("day").alias("lo"))
    return lo.select("region", F.explode(F.sequence("lo", F.date_add("lo", 6))).alias("day"))


@query("prj09_terrace_candidates", "SELECT id, CAST(k AS INTEGER) AS candidate, floor((lat + cos(radians(b)) * d / 111320e0) * 1e8 + 0.5) / 1e8 AS c_lat, floor((lon + sin(radians(b)) * d / (111320e0 * greatest(cos(radians(lat)), 0.01e0))) * 1e8 + 0.5) / 1e8 AS c_lon FROM places, (SELECT k, CASE WHEN k = 0 THEN 0 WHEN k <= 8 THEN 4 ELSE 8 END AS d, CASE WHEN k = 0 THEN 0 ELSE ((k - 1) % 8) * 45 END AS b FROM range(17) r(k))", "places")
def _(t: Tables) -> DataFrame:
    return grids.terrace_candidates(t.places()).select("id", "candidate", half_up("c_lat", 8).alias("c_lat"), half_up("c_lon", 8).alias("c_lon"))


@query("prj10_probe_points", f"WITH {_TILE_SQL}, r AS (SELECT * FROM (VALUES (0, 0.2e0), (1, 0.5e0), (2, 0.8e0)) v(k, u)) SELECT tile_id, a.k AS i, b.k AS j, min_e + a.u * 250 AS e, min_n + b.u * 250 AS n FROM tl, r a, r b")
def _(t: Tables) -> DataFrame:
    return grids.probe_points(_tiles(t))


@query("prj11_tile_corners", f"WITH {_TILE_SQL} SELECT tile_id, min_e AS west, min_n + 250 AS north, min_e + 250 AS east, min_n AS south FROM tl")
def _(t: Tables) -> DataFrame:
    return _tiles(t).select("tile_id", F.col("min_e").alias("west"), F.col("max_n").alias("north"), F.col("max_e").alias("east"), F.col("min_n").alias("south"))


@query("prj12_outdoor_index", "SELECT tile, id, CASE WHEN NOT indoor THEN row_number() OVER (PARTITION BY tile, indoor ORDER BY iy, ix) - 1 END AS outdoor_index FROM (SELECT id % 7 AS tile, id, CAST(floor(id / 60) AS BIGINT) AS iy, id % 60 AS ix, id % 4 = 0 AS indoor FROM obstacles)", "obstacles")
def _(t: Tables) -> DataFrame:
    k = F.col("id")
    pts = t.obstacles().select((k % 7).alias("tile"), "id", F.floor(k / 60).alias("iy"), (k % 60).alias("ix"), (k % 4 == 0).alias("indoor"))
    return grids.outdoor_index(pts, "tile").select("tile", "id", F.col("outdoor_index").cast("bigint").alias("outdoor_index"))


@query("prj14_compact_tile_id", "SELECT p_partkey AS id, (2538000 // 250 + p_partkey) || '_' || (1152000 // 250 + p_size) AS short FROM part")
def _(t: Tables) -> DataFrame:
    from ..functions.text import compact_tile_id

    k = F.col("p_partkey")
    return t.read("part").select(k.alias("id"), compact_tile_id(grids.tile_id(2_538_000 + k * 250, 1_152_000 + F.col("p_size") * 250, 250)).alias("short"))


@query("str03_tile_parts", "SELECT p_partkey AS id, 2538000 + p_partkey * 250 AS e, CAST(1152000 + p_size * 250 AS BIGINT) AS n, CAST(250 AS BIGINT) AS size FROM part")
def _(t: Tables) -> DataFrame:
    from ..functions.text import tile_parts

    k = F.col("p_partkey")
    ids = t.read("part").select(k.alias("id"), grids.tile_id(2_538_000 + k * 250, 1_152_000 + F.col("p_size") * 250, 250).alias("tile"))
    return ids.select("id", tile_parts("tile").alias("p")).select("id", "p.e", "p.n", "p.size")


@query("prj15_canopy", "SELECT event_id, 400 + (event_id % 50) + greatest(0, value) AS z FROM events")
def _(t: Tables) -> DataFrame:
    ground = t.events().select("event_id", (400 + F.col("event_id") % 50).alias("ground"))
    return ground.join(t.events().select("event_id", "value"), "event_id").select("event_id", (F.col("ground") + F.greatest(F.lit(0.0), "value")).alias("z"))


@query("dt01_local_to_utc", "SELECT event_id, timezone('Europe/Zurich', CAST(ts AS TIMESTAMP))::TIMESTAMP AS utc FROM events")
def _(t: Tables) -> DataFrame:
    return t.events().select("event_id", zones.to_utc("ts", "Europe/Zurich").alias("utc"))


@query("dt02_day_range", "SELECT day, CAST(epoch(timezone('Europe/Zurich', CAST(day + INTERVAL 1 DAY AS TIMESTAMP))) - epoch(timezone('Europe/Zurich', CAST(day AS TIMESTAMP))) AS BIGINT) // 3600 AS hours FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)")
def _(t: Tables) -> DataFrame:
    days = t.runs().select("day").distinct().withColumn("r", zones.day_range("day", "Europe/Zurich"))
    return days.select("day", ((F.unix_micros("r.end") - F.unix_micros("r.start")) / 3_600_000_000).cast("bigint").alias("hours"))


@query("dt03_local_text", "SELECT event_id, strftime(timezone('Europe/Zurich', CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS local FROM events")
def _(t: Tables) -> DataFrame:
    return t.events().select("event_id", zones.local_text("ts", "Europe/Zurich").alias("local"))


@query("dt05_slot_floor", "SELECT event_id, CAST(floor((hour(ts) * 60 + minute(ts)) / 15) * 15 AS INTEGER) AS slot FROM events")
def _(t: Tables) -> DataFrame:
    return t.events().select("event_id", (F.floor((F.hour("ts") * 60 + F.minute("ts")) / 15) * 15).cast("int").alias("slot"))


@query("mth18_next_weekends", "SELECT run, day + CAST((5 - dayofweek(day) + 7) % 7 AS INTEGER) + CAST(w * 7 + k AS INTEGER) AS day2, CAST(w AS INTEGER) AS weekend FROM runs, range(2) a(w), range(3) b(k)", "runs")
def _(t: Tables) -> DataFrame:
    r = t.runs()
    friday = F.date_add("day", F.pmod(6 - F.dayofweek("day"), F.lit(7)))
    each = r.select("run", friday.alias("f"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("weekend")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return each.select("run", F.date_add("f", F.col("weekend") * 7 + F.col("k")).alias("day2"), "weekend")


@query("mth21_frames_per_day", "SELECT run, CASE WHEN s > 0 AND e >= b THEN CAST(floor((e - b) / s) AS BIGINT) + 1 END AS frames FROM (SELECT run, run % 4 * 5 AS s, 360 + run % 60 AS b, 300 + run % 900 AS e FROM runs)", "runs")
def _(t: Tables) -> DataFrame:
    k = F.col("run")
    r = t.runs().select("run", (k % 4 * 5).alias("s"), (360 + k % 60).alias("b"), (300 + k % 900).alias("e"))
    return r.select("run", F.when((F.col("s") > 0) & (F.col("e") >= F.col("b")), F.floor((F.col("e") - F.col("b")) / F.col("s")) + 1).alias("frames"))


@query("agg45_interpolation_error", "SELECT floor(max(err) * 1e9 + 0.5) / 1e9 AS worst, floor(avg(err) * 1e9 + 0.5) / 1e9 AS mean FROM (SELECT abs((u * u + v * v) - (u * (1 - v) + (1 - u) * v + 2 * u * v)) AS err FROM (SELECT i / 64e0 AS u, j / 64e0 AS v FROM range(65) a(i), range(65) b(j)))")
def _(t: Tables) -> DataFrame:
    uv = t.spark.range(65 * 65).select((F.floor(F.col("id") / 65) / 64.0).alias("u"), (F.col("id") % 65 / 64.0).alias("v"))
    err = F.abs(F.col("u") * F.col("u") + F.col("v") * F.col("v") - geo.bi_affine("u", "v", *(F.lit(float(c)) for c in (0, 1, 1, 2))))
    return uv.agg(half_up(F.max(err), 9).alias("worst"), half_up(F.avg(err), 9).alias("mean"))


@query("agg37_downsample", """SELECT tile, px, py, count(*) AS n, 2 * sum(CASE WHEN sunny THEN 1 ELSE 0 END) >= count(*) AS box, bool_or(NOT sunny) AS any_shadow FROM (SELECT id % 5 AS tile, CAST(floor(id % 40 / 4) AS BIGINT) AS px, CAST(floor(id / 40 / 4) AS BIGINT) AS py, id % 3 > 0 AS sunny FROM obstacles) GROUP BY 1, 2, 3""", "obstacles")
def _(t: Tables) -> DataFrame:
    k = F.col("id")
    px = t.obstacles().select((k % 5).alias("tile"), F.floor(k % 40 / 4).alias("px"), F.floor(k / 40 / 4).alias("py"), (k % 3 > 0).alias("sunny"))
    return px.groupBy("tile", "px", "py").agg(F.count("*").alias("n"), (2 * F.count_if("sunny") >= F.count("*")).alias("box"), F.bool_or(~F.col("sunny")).alias("any_shadow"))


@query("win12_dense_rows", "SELECT id, CAST(dense_rank() OVER (ORDER BY floor(min_y)) - 1 AS INTEGER) AS row FROM obstacles", "obstacles")
def _(t: Tables) -> DataFrame:
    o = t.obstacles()  # the distinct rows of a grid are few, and only they are numbered in one task
    rows = o.select(F.floor("min_y").alias("y")).distinct().withColumn("row", F.row_number().over(Window.orderBy("y")) - 1)
    return o.withColumn("y", F.floor("min_y")).join(rows, "y").select("id", "row")
