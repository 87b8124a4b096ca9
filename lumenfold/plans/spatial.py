"""Joins by place: regions, tiles, cells, rays and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, rings
from ..functions.numbers import half_up
from ..operators import grids, spatial, windows
from ..sources.tables import Tables
from .registry import query


@query("join01_containing_region", "SELECT p.id, arg_min(r.region, r.ord) AS region FROM places p LEFT JOIN regions_ r ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat GROUP BY p.id", "places", "regions_")
def _(t: Tables) -> DataFrame:
    return spatial.containing_region(t.places(), t.regions(), "id")


def _boxes(t: Tables) -> DataFrame:
    k = F.col("id") % 40 * 0.001
    b = t.places().select("id", (F.col("lon") - 0.05 + k).alias("q_min_lon"), (F.col("lat") - 0.03).alias("q_min_lat"))
    return b.withColumn("q_max_lon", F.col("q_min_lon") + 0.02).withColumn("q_max_lat", F.col("q_min_lat") + 0.02)


_BOX_SQL = "bx AS (SELECT id, lon - 0.05e0 + id % 40 * 1e-3 AS a, lat - 0.03e0 AS b FROM places), bxs AS (SELECT id, a AS qa, b AS qb, a + 0.02e0 AS qc, b + 0.02e0 AS qd FROM bx)"


@query("join02_region_of_box", f"""WITH {_BOX_SQL}, j AS (SELECT *, min_lon <= qa AND max_lon >= qc AND min_lat <= qb AND max_lat >= qd AS w, greatest(0, least(max_lon, qc) - greatest(min_lon, qa)) * greatest(0, least(max_lat, qd) - greatest(min_lat, qb)) AS area FROM bxs, regions_),
  k AS (SELECT id, arg_min(region, (CASE WHEN w THEN 0 ELSE 1 END, CASE WHEN w THEN 0 ELSE -area END, ord)) AS region FROM j WHERE w OR area > 0 GROUP BY id) SELECT bxs.id, k.region FROM bxs LEFT JOIN k USING (id)""", "places", "regions_")
def _(t: Tables) -> DataFrame:
    return spatial.region_of_box(_boxes(t), t.regions(), "id")


@query("flt01_in_box", "SELECT id FROM places WHERE lon BETWEEN 6.6e0 AND 6.65e0 AND lat BETWEEN 46.49e0 AND 46.494e0", "places")
def _(t: Tables) -> DataFrame:
    return t.places().where(F.col("lon").between(6.6, 6.65) & F.col("lat").between(46.49, 46.494)).select("id")


@query("flt02_boxes_meet", f"WITH {_BOX_SQL} SELECT id, region FROM bxs, regions_ WHERE qa <= max_lon AND qc >= min_lon AND qb <= max_lat AND qd >= min_lat", "places", "regions_")
def _(t: Tables) -> DataFrame:
    return spatial.boxes_meeting(_boxes(t), t.regions()).select("id", "region")


@query("flt03_box_contains", f"WITH {_BOX_SQL} SELECT id, region FROM bxs, regions_ WHERE min_lon <= qa AND max_lon >= qc AND min_lat <= qb AND max_lat >= qd", "places", "regions_")
def _(t: Tables) -> DataFrame:
    return spatial.boxes_meeting(_boxes(t), t.regions()).where(geo.box_contains("", "q_")).select("id", "region")


@query("join04_point_to_tile", "SELECT id, CAST(floor(center_x / 250) * 250 AS BIGINT) AS tile_e, CAST(floor(center_y / 250) * 250 AS BIGINT) AS tile_n FROM obstacles", "obstacles")
def _(t: Tables) -> DataFrame:
    return spatial.tiles_of_points(t.obstacles().withColumn("e", F.col("center_x")).withColumn("n", F.col("center_y"))).select("id", "tile_e", "tile_n")


@query("join05_point_to_cell", "SELECT p.probe, count(o.id) AS n FROM probes p LEFT JOIN obstacles o ON floor(p.x / 20) = floor(o.center_x / 20) AND floor(p.y / 20) = floor(o.center_y / 20) GROUP BY p.probe", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    cell = lambda x, y: (F.floor(F.col(x) / 20).alias("ix"), F.floor(F.col(y) / 20).alias("iy"))
    p, o = t.probes().select("probe", *cell("x", "y")), t.obstacles().select("id", *cell("center_x", "center_y"))
    return p.join(o, ["ix", "iy"], "left").groupBy("probe").agg(F.count("id").alias("n"))


_CELLS = "cells AS (SELECT id, cx, cy, max_z FROM (SELECT *, unnest(range(CAST(floor(min_x / 64) AS BIGINT), CAST(floor(max_x / 64) AS BIGINT) + 1)) AS cx FROM obstacles), range(-2, 40) r(cy) WHERE cy BETWEEN floor(min_y / 64) AND floor(max_y / 64))"


@query("join07_obstacle_cells", f"WITH {_CELLS} SELECT id, cx, cy FROM cells", "obstacles")
def _(t: Tables) -> DataFrame:
    return spatial.obstacle_cells(t.obstacles()).select("id", F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy"))


@query("agg17_cell_heights", f"WITH {_CELLS} SELECT cx, cy, max(max_z) AS cell_max_z, count(*) AS n FROM cells GROUP BY 1, 2", "obstacles")
def _(t: Tables) -> DataFrame:
    return spatial.cell_heights(spatial.obstacle_cells(t.obstacles())).select(F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy"), "cell_max_z", "n")


_RAYS = """pr AS (SELECT *, sin(radians(azimuth)) AS dx, cos(radians(azimuth)) AS dy FROM probes WHERE altitude > 0),
c0 AS (SELECT p.*, o.*, o.center_x - p.x AS ex, o.center_y - p.y AS ey FROM pr p, obstacles o),
c1 AS (SELECT *, ex * dx + ey * dy AS along, abs(ex * dy - ey * dx) AS across FROM c0),
cand AS (SELECT * FROM c1 WHERE along >= -half_diagonal AND across <= half_diagonal AND sqrt(ex * ex + ey * ey) <= 400 + half_diagonal AND max_z >= z + greatest(0, along - half_diagonal) * tan(radians(altitude))),
b0 AS (SELECT *, CASE WHEN abs(dx) < 1e-9 THEN CASE WHEN x BETWEEN min_x AND max_x THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END ELSE least((min_x - x) / dx, (max_x - x) / dx) END AS nx,
  CASE WHEN abs(dx) < 1e-9 THEN CASE WHEN x BETWEEN min_x AND max_x THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE greatest((min_x - x) / dx, (max_x - x) / dx) END AS fx,
  CASE WHEN abs(dy) < 1e-9 THEN CASE WHEN y BETWEEN min_y AND max_y THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END ELSE least((min_y - y) / dy, (max_y - y) / dy) END AS ny,
  CASE WHEN abs(dy) < 1e-9 THEN CASE WHEN y BETWEEN min_y AND max_y THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE greatest((min_y - y) / dy, (max_y - y) / dy) END AS fy FROM cand),
b1 AS (SELECT *, greatest(0, nx, ny) AS distance, least(fx, fy) AS leave FROM b0),
hits AS (SELECT *, degrees(atan2(max_z - z, greatest(1, distance))) AS angle FROM b1 WHERE distance <= leave AND distance <= 400 AND max_z > z)"""


@query("join08_ray_candidates", f"WITH {_RAYS} SELECT probe, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM cand GROUP BY probe", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    c = spatial.ray_candidates(t.probes(), t.obstacles(), 400.0)
    return c.groupBy("probe").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("join09_nearest_blocker", f"""WITH {_RAYS}, best AS (SELECT probe, min((distance, id, angle)) AS b FROM hits WHERE altitude <= angle GROUP BY probe)
  SELECT p.probe, b.b IS NOT NULL AS blocked, b.b[2] AS blocker, floor(b.b[1] * 1e3 + 0.5) / 1e3 AS distance, floor(b.b[3] * 1e3 + 0.5) / 1e3 AS angle FROM probes p LEFT JOIN best b USING (probe)""", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    return spatial.nearest_blocker(t.probes(), t.obstacles(), 400.0)


@query("shd10_prism_hits", f"WITH {_RAYS} SELECT probe, id, floor(distance * 1e3 + 0.5) / 1e3 AS distance FROM hits WHERE altitude <= angle", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    h = spatial.ray_hits(spatial.ray_candidates(t.probes(), t.obstacles(), 400.0), 400.0)
    return h.select("probe", "id", half_up("distance", 3).alias("distance"))


@query("join10_verified_blocker", f"""WITH {_RAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY distance, id) AS rank FROM hits WHERE altitude <= angle), g AS (SELECT probe, min((rank, id)) AS b FROM r WHERE rank <= 4 AND id % 3 <> 0 GROUP BY probe) SELECT probe, b[2] AS blocker, b[1] AS rank FROM g""", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    h = spatial.ray_hits(spatial.ray_candidates(t.probes(), t.obstacles(), 400.0), 400.0)
    return spatial.verified_blocker(h, F.col("id") % 3 != 0, tries=4).select("probe", "blocker", F.col("rank").cast("bigint").alias("rank"))


@query("shd11_ray_to_box", f"WITH {_RAYS} SELECT probe, count(*) AS n, floor(min(distance) * 1e6 + 0.5) / 1e6 AS nearest FROM hits GROUP BY probe", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    c = spatial.ray_candidates(t.probes(), t.obstacles(), 400.0).withColumn("d", rings.ray_to_box("x", "y", "dx", "dy", "min_x", "min_y", "max_x", "max_y"))
    return c.where("d <= 400 and max_z > z").groupBy("probe").agg(F.count("*").alias("n"), half_up(F.min("d"), 6).alias("nearest"))


@query("join19_allowed_obstacles", f"WITH {_RAYS} SELECT DISTINCT id FROM cand", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    c = spatial.ray_candidates(t.probes(), t.obstacles(), 400.0).select("id")
    return t.obstacles().select("id").join(c, "id", "left_semi")


@query("agg34_culling_yield", f"WITH {_RAYS} SELECT (SELECT count(*) FROM obstacles) AS total, count(DISTINCT c.id) AS kept, count(DISTINCT h.id) AS impacted FROM cand c LEFT JOIN (SELECT DISTINCT id FROM hits WHERE altitude <= angle) h USING (id)", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    c = spatial.ray_candidates(t.probes(), t.obstacles(), 400.0)
    box = rings.ray_to_box("x", "y", "dx", "dy", "min_x", "min_y", "max_x", "max_y")
    angle = F.degrees(F.atan2(F.col("max_z") - F.col("z"), F.greatest(F.lit(1.0), box)))
    blocks = F.coalesce((box <= 400) & (F.col("max_z") > F.col("z")) & (F.col("altitude") <= angle), F.lit(False))
    kept = c.select("id", F.lit(True).alias("kept"), blocks.alias("hit"))
    each = kept.unionByName(t.obstacles().select("id", F.lit(False).alias("kept"), F.lit(False).alias("hit"))).groupBy("id").agg(F.bool_or("kept").alias("kept"), F.bool_or("hit").alias("hit"))
    return each.agg(F.count("*").alias("total"), F.count_if("kept").alias("kept"), F.count_if("hit").alias("impacted"))


@query("udf05_rejections", f"""WITH {_RAYS}, b2 AS (SELECT CASE WHEN NOT (distance <= leave) THEN 'box missed' WHEN distance > 400 THEN 'too far' WHEN max_z <= z THEN 'too low' WHEN altitude > degrees(atan2(max_z - z, greatest(1, distance))) THEN 'below the sun' ELSE 'blocks' END AS label FROM b1) SELECT label, count(*) AS n FROM b2 GROUP BY label""", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    c = spatial.ray_candidates(t.probes(), t.obstacles(), 400.0).withColumn("d", rings.ray_to_box("x", "y", "dx", "dy", "min_x", "min_y", "max_x", "max_y"))
    angle = F.degrees(F.atan2(F.col("max_z") - F.col("z"), F.greatest(F.lit(1.0), "d")))
    label = F.when(F.col("d").isNull(), "box missed").when(F.col("d") > 400, "too far").when(F.col("max_z") <= F.col("z"), "too low").when(F.col("altitude") > angle, "below the sun").otherwise("blocks")
    return c.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("join11_nearest_mesh", "WITH m AS (SELECT s_suppkey AS mesh, s_suppkey * 7 % 1000 + 0.5e0 AS mx, s_suppkey * 11 % 800 + 0.25e0 AS my FROM supplier), s AS (SELECT o.id, m.mesh, sqrt(pow(center_x - mx, 2) + pow(center_y - my, 2)) AS score FROM obstacles o JOIN m ON abs(center_x - mx) <= 6 AND abs(center_y - my) <= 6) SELECT id, arg_min(mesh, (score, mesh)) AS mesh FROM s WHERE score <= 6 GROUP BY id", "obstacles")
def _(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    m = t.read("supplier").select(k.alias("mesh"), (k * 7 % 1000 + 0.5).alias("x"), (k * 11 % 800 + 0.25).alias("y"))
    o = t.obstacles().select("id", F.col("center_x").alias("x"), F.col("center_y").alias("y"))
    return spatial.nearest_within(o, m, "id", "mesh", 6.0).select("id", "mesh")


_FOUND = "sg AS (SELECT s_suppkey AS found, 46.4902e0 + (s_suppkey % 130) * 1e-3 AS lat, 6.5403e0 + (s_suppkey * 13 % 260) * 1e-3 AS lon FROM supplier)"


def _found(t: Tables) -> DataFrame:
    """Suggestions of a geocoder, part of them near places."""
    k = F.col("s_suppkey")
    return t.read("supplier").select(k.alias("found"), (46.4902 + (k % 130) * 0.001).alias("lat"), (6.5403 + (k * 13 % 260) * 0.001).alias("lon"))


@query("join13_near_suggestions", f"WITH {_FOUND} SELECT found FROM sg a WHERE NOT EXISTS (SELECT 1 FROM places b WHERE abs(a.lat - b.lat) < 0.0005e0 AND abs(a.lon - b.lon) < 0.0007e0)", "places")
def _(t: Tables) -> DataFrame:
    return spatial.near_duplicates_of(_found(t), t.places().select("id", "lat", "lon"), 0.0005, 0.0007).select("found")


@query("flt14_near_pairs", f"WITH {_FOUND} SELECT found, id FROM sg a JOIN places b ON abs(a.lat - b.lat) < 0.0005e0 AND abs(a.lon - b.lon) < 0.0007e0", "places")
def _(t: Tables) -> DataFrame:
    return spatial.near_pairs(_found(t), t.places().select("id", "lat", "lon"), 0.0005, 0.0007).select("found", "id")


@query("join14_exclude_held", "SELECT id FROM places WHERE id NOT IN (SELECT s_suppkey FROM supplier)", "places")
def _(t: Tables) -> DataFrame:
    return t.places().select("id").join(t.probes().select(F.col("probe").alias("id")), "id", "left_anti")


@query("join16_first_cached_hash", "SELECT region, arg_min(priority, priority) AS priority, count(*) FILTER (WHERE priority = m) AS n FROM (SELECT *, min(priority) OVER (PARTITION BY region) AS m FROM runs WHERE owner IN (SELECT id FROM places WHERE seating)) GROUP BY region", "runs", "places")
def _(t: Tables) -> DataFrame:
    held = t.runs().join(t.places().where("seating").select(F.col("id").alias("owner")), "owner", "left_semi")
    per = held.groupBy("region", "priority").agg(F.count("*").alias("n"))
    return windows.first_by(per, ["region"], [F.col("priority")]).select("region", "priority", "n")


@query("join17_first_outdoor_candidate", "WITH c AS (SELECT id, k FROM places, range(17) r(k)) SELECT id, CAST(min(k) AS INTEGER) AS candidate FROM c WHERE (id * 31 + k * 17) % 5 > 1 GROUP BY id", "places")
def _(t: Tables) -> DataFrame:
    c = grids.terrace_candidates(t.places()).withColumn("indoor", (F.col("id") * 31 + F.col("candidate") * 17) % 5 <= 1)
    return c.where(~F.col("indoor")).groupBy("id").agg(F.min("candidate").alias("candidate"))


@query("join20_focus_zone", "SELECT id FROM obstacles WHERE min_x <= 1200 AND max_x >= 300 AND min_y <= 700 AND max_y >= 100", "obstacles")
def _(t: Tables) -> DataFrame:
    return t.obstacles().where("min_x <= 1200 and max_x >= 300 and min_y <= 700 and max_y >= 100").select("id")


@query("join22_closest_point", "SELECT probe, arg_min(id, (d, id)) AS id FROM (SELECT probe, id, pow(x - center_x, 2) + pow(y - center_y, 2) AS d FROM probes, obstacles) GROUP BY probe", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    o = t.obstacles().select("id", F.col("center_x").alias("x"), F.col("center_y").alias("y"))
    return spatial.nearest_point(t.probes().select("probe", "x", "y"), o, "probe", "id").select("probe", "id")


@query("join28_nearest_named", "SELECT id, arg_min(region, (d, region)) AS region FROM (SELECT id, region, pow(lat - (min_lat + max_lat) / 2, 2) + pow((lon - (min_lon + max_lon) / 2) * 0.69e0, 2) AS d FROM places, regions_) GROUP BY id", "places", "regions_")
def _(t: Tables) -> DataFrame:
    score = lambda r: F.pow(F.col("lat") - (r["min_lat"] + r["max_lat"]) / 2, 2) + F.pow((F.col("lon") - (r["min_lon"] + r["max_lon"]) / 2) * 0.69, 2)
    return spatial.nearest(t.places().select("id", "lat", "lon"), t.regions(), "id", score, "region").select("id", "region")


@query("join25_orphans", "SELECT DISTINCT p_brand AS brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49 AND p_partkey % 3 = 0)")
def _(t: Tables) -> DataFrame:
    p = t.read("part").select(F.col("p_brand").alias("brand"), "p_size", "p_partkey")
    return p.select("brand").distinct().join(p.where("p_size > 49 and p_partkey % 3 = 0").select("brand"), "brand", "left_anti")


@query("join27_tile_membership", "SELECT tile, arg_min(az_b % 4, az_b % 4) AS first, count(DISTINCT az_b % 4) AS n FROM buckets GROUP BY tile", "buckets")
def _(t: Tables) -> DataFrame:
    m = t.buckets().select("tile", (F.col("az_b") % 4).alias("region")).distinct()
    return m.groupBy("tile").agg(F.min("region").alias("first"), F.count("*").alias("n"))


@query("join24_mesh_region", "SELECT o.id, arg_min(r.region, r.ord) AS region FROM (SELECT id, 6.4e0 + center_x / 2000 AS lon, 46.45e0 + center_y / 5000 AS lat FROM obstacles) o JOIN regions_ r ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat GROUP BY o.id", "obstacles", "regions_")
def _(t: Tables) -> DataFrame:
    o = t.obstacles().select("id", (6.4 + F.col("center_x") / 2000).alias("lon"), (46.45 + F.col("center_y") / 5000).alias("lat"))
    return spatial.containing_region(o, t.regions(), "id").where("region is not null")


@query("agg28_distance_histogram", """WITH a AS (SELECT id, CAST(floor(center_x / 20) AS BIGINT) AS i, CAST(floor(center_y / 20) AS BIGINT) AS j FROM obstacles), b AS (SELECT DISTINCT CAST(floor(x / 20) AS BIGINT) AS i, CAST(floor(y / 20) AS BIGINT) AS j FROM probes), d AS (SELECT a.id, min(greatest(abs(a.i - b.i), abs(a.j - b.j))) AS d FROM a, b GROUP BY a.id) SELECT d AS distance, count(*) AS n FROM d GROUP BY d""", "obstacles", "probes")
def _(t: Tables) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / 20).cast("double")
    a = t.obstacles().select("id", cell("center_x").alias("x"), cell("center_y").alias("y"))
    b = t.probes().select("probe", cell("x").alias("x"), cell("y").alias("y"))
    near = spatial.nearest_point(a, b, "id", "probe", size=2.0, chebyshev=True)
    return near.groupBy(F.col("distance").cast("bigint").alias("distance")).agg(F.count("*").alias("n"))
