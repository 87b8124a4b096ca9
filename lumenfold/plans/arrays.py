"""Bit masks, rings, maps, JSON and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, rings
from ..functions.numbers import half_up
from ..sources.tables import Tables
from .registry import query


@query("arr01_test_bits", "SELECT vec_id, embedding[6] > 0 AS b5, embedding[64] > 0 AS b63 FROM embeddings")
def _(t: Tables) -> DataFrame:
    return t.packed().select("vec_id", bits.test("mask", 5).alias("b5"), bits.test("mask", 63).alias("b63"))


@query("arr02_popcount", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n FROM embeddings")
def _(t: Tables) -> DataFrame:
    return t.packed().select("vec_id", F.bit_count("mask").alias("n"))


@query("arr03_pack_rows", "SELECT vec_id, CAST(i // 32 AS INTEGER) AS word, CAST(sum(CASE WHEN bit THEN CAST(1 AS BIGINT) << (i % 32) ELSE 0 END) AS BIGINT) AS mask FROM masks GROUP BY vec_id, i // 32", "masks")
def _(t: Tables) -> DataFrame:
    m = t.masks().withColumn("word", F.floor(F.col("i") / 32).cast("int")).withColumn("k", F.col("i") % 32)
    return m.groupBy("vec_id", "word").agg(bits.pack_rows("bit", "k").alias("mask"))


@query("arr04_remap", "SELECT vec_id, CAST(i * 7 % 64 // 32 AS INTEGER) AS word, CAST(sum(CASE WHEN bit THEN CAST(1 AS BIGINT) << (i * 7 % 32) ELSE 0 END) AS BIGINT) AS mask FROM masks GROUP BY 1, 2", "masks")
def _(t: Tables) -> DataFrame:
    cell = t.spark.range(64).select(F.col("id").cast("int").alias("i"), (F.col("id") * 7 % 64).cast("int").alias("cell"))
    m = t.masks().join(F.broadcast(cell), "i").withColumn("word", F.floor(F.col("cell") / 32).cast("int")).withColumn("k", F.col("cell") % 32)
    return m.groupBy("vec_id", "word").agg(bits.pack_rows("bit", "k").alias("mask"))


@query("arr05_mask_slice", "SELECT label, count(*) FILTER (WHERE bit) AS n FROM masks WHERE i BETWEEN 8 AND 15 GROUP BY label", "masks")
def _(t: Tables) -> DataFrame:
    part = F.shiftrightunsigned("mask", 8).bitwiseAND(255)
    return t.packed().groupBy("label").agg(F.sum(F.bit_count(part)).alias("n"))


@query("agg25_bit_differences", "SELECT a.vec_id, CAST(len(list_filter(range(1, 65), lambda i: (a.embedding[i] > 0) <> (b.embedding[i] > 0))) AS INTEGER) AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t: Tables) -> DataFrame:
    a, b = t.packed(), t.packed().select((F.col("vec_id") - 1).alias("vec_id"), F.col("mask").alias("other"))
    return a.join(b, "vec_id").select("vec_id", bits.differing("mask", "other").alias("n"))


@query("dq10_popcount_agrees", "SELECT label, count(*) AS n, count(*) FILTER (WHERE c >= 32) AS many FROM (SELECT label, len(list_filter(embedding, lambda x: x > 0)) AS c FROM embeddings) GROUP BY label")
def _(t: Tables) -> DataFrame:
    return t.packed().groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.bit_count("mask") >= 32).alias("many"))


@query("dq11_midday_masks", "SELECT label, count(*) FILTER (WHERE bit) AS blocked, count(*) AS n FROM masks WHERE i = 12 GROUP BY label", "masks")
def _(t: Tables) -> DataFrame:
    return t.packed().groupBy("label").agg(F.count_if(bits.test("mask", 12)).alias("blocked"), F.count("*").alias("n"))


@query("dq12_empty_masks", "SELECT vec_id FROM (SELECT vec_id, count(*) FILTER (WHERE bit AND i < 32) AS a, count(*) FILTER (WHERE bit AND i >= 32) AS b FROM masks GROUP BY vec_id) WHERE a < 13 AND b > 14", "masks")
def _(t: Tables) -> DataFrame:
    low, high = F.bit_count(F.col("mask").bitwiseAND(0xFFFFFFFF)), F.bit_count(F.shiftrightunsigned("mask", 32))
    return t.packed().where((low < 13) & (high > 14)).select("vec_id")


@query("dq13_point_order", "SELECT count(*) FILTER (WHERE a.label <> b.label) AS differing, min(CASE WHEN a.label <> b.label THEN a.vec_id END) AS first FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t: Tables) -> DataFrame:
    e = t.read("embeddings").select("vec_id", "label")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other")), "vec_id")
    off = F.col("label") != F.col("other")
    return j.agg(F.count_if(off).alias("differing"), F.min(F.when(off, F.col("vec_id"))).alias("first"))


@query("dq16_mask_overlap", "SELECT a.vec_id, CAST(len(list_filter(range(1, 65), lambda i: a.embedding[i] > 0 AND b.embedding[i] > 0)) AS INTEGER) AS both, CAST(len(list_filter(range(1, 65), lambda i: a.embedding[i] > 0 AND NOT b.embedding[i] > 0)) AS INTEGER) AS only_a FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t: Tables) -> DataFrame:
    j = t.packed().join(t.packed().select((F.col("vec_id") - 1).alias("vec_id"), F.col("mask").alias("o")), "vec_id")
    return j.select("vec_id", F.bit_count(F.col("mask").bitwiseAND(F.col("o"))).alias("both"), F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not("o"))).alias("only_a"))


@query("agg11_repacked_timeline", "SELECT user_id, CAST(r // 60 AS INTEGER) AS word, CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(1 AS BIGINT) << (r % 60) ELSE 0 END) AS BIGINT) AS mask FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("point").orderBy("ts", "ord")) - 1
    e = t.samples().withColumn("r", r).withColumn("word", F.floor(F.col("r") / 60).cast("int")).withColumn("k", F.col("r") % 60)
    return e.groupBy(F.col("point").alias("user_id"), "word").agg(bits.pack_rows("is_sunny", "k").alias("mask"))


def _ring(t: Tables) -> DataFrame:
    """A five-sided house around each obstacle: its box with a gable."""
    pt = lambda x, y: F.struct(F.col(x).alias("x") if isinstance(x, str) else x.alias("x"), F.col(y).alias("y") if isinstance(y, str) else y.alias("y"))
    return t.obstacles().withColumn("ring", F.array(pt("min_x", "min_y"), pt("max_x", "min_y"), pt("max_x", "max_y"), pt(F.col("center_x"), F.col("max_y") + 2), pt("min_x", "max_y")))


@query("mth09_ring_area", "SELECT id, (max_x - min_x) * (max_y - min_y) + (max_x - min_x) * 2 / 2 AS area FROM obstacles", "obstacles")
def _(t: Tables) -> DataFrame:
    return _ring(t).select("id", rings.area("ring").alias("area"))


@query("mth09_convex_hull", "SELECT id, CAST(CASE WHEN id % 2 = 0 THEN 5 ELSE 4 END AS INTEGER) AS corners, (max_x - min_x) * (max_y - min_y) + CASE WHEN id % 2 = 0 THEN max_x - min_x ELSE 0 END AS area, id % 2 = 0 AS simple FROM obstacles", "obstacles")
def _(t: Tables) -> DataFrame:
    """Hulls of scattered points of a house (of a box for odd ids), and whether a ring is simple: odd ids cross their walls."""
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    cx, cy = F.col("center_x"), F.col("center_y")
    inner = F.transform(F.sequence(F.lit(0), (F.col("id") % 7).cast("int")), lambda k: pt(cx + (k - 3) * 0.2, cy + (k * k % 5 - 2) * 0.3))
    even = F.col("id") % 2 == 0
    box = F.array(*(pt(F.col(x), F.col(y)) for x, y in (("min_x", "min_y"), ("max_x", "max_y"), ("max_x", "min_y"), ("min_x", "max_y"))))
    points = F.concat(inner, box, F.when(even, F.slice("ring", 4, 1)).otherwise(F.slice("ring", 1, 1)))
    out = _ring(t).select("id", rings.hull(points).alias("h"), F.when(even, rings.is_simple("ring")).otherwise(rings.is_simple(box)).alias("simple"))
    return out.select("id", F.size("h").alias("corners"), rings.area("h").alias("area"), "simple")


def _crooked(t: Tables) -> DataFrame:
    """By number: a bow tie, a star of eight spikes, an L begun at its foot's end, and a box with a spike that runs out and back."""
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, x1, y1, cx, cy = (F.col(c) for c in ("min_x", "min_y", "max_x", "max_y", "center_x", "center_y"))
    tip = lambda k: F.when(k % 2 == 0, 30.0).otherwise(1.0)
    star = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: pt(cx + tip(k) * F.cos(k * 0.39269908169872414), cy + tip(k) * F.sin(k * 0.39269908169872414)))
    bow = F.array(pt(x0, y0), pt(x1, y1), pt(x1, y0), pt(x0, y1))
    ell = F.array(pt(x1, y0), pt(x1, cy), pt(cx, cy), pt(cx, y1), pt(x0, y1), pt(x0, y0), pt(x1, y0))
    spike = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(cx, y1), pt(cx, y1 + 5), pt(cx, y1 + 1), pt(x0, y1 + 1))
    n = F.col("id") % 4
    return t.obstacles().withColumn("ring", F.when(n == 0, bow).when(n == 1, star).when(n == 2, ell).otherwise(spike))


@query("mth09_repaired", """SELECT id, CAST(CASE id % 4 WHEN 0 THEN 3 WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 6 END AS INTEGER) AS corners, id % 4 = 1 AS used_hull,
  floor(1e6 * CASE id % 4 WHEN 0 THEN w * d / 4 WHEN 1 THEN 8 * 900 * sin(pi() / 4) / 2 WHEN 2 THEN w * d * 0.75e0 ELSE w * d + w / 2 END + 0.5) / 1e6 AS area FROM (SELECT id, max_x - min_x AS w, max_y - min_y AS d FROM obstacles)""", "obstacles")
def _(t: Tables) -> DataFrame:
    """Bow ties become a triangle, stars their hull, spikes without an area go, L shapes stay."""
    from ..operators import footprints

    out = footprints.normalised(_crooked(t))
    return out.select("id", F.size("footprint").alias("corners"), "used_hull", half_up(rings.area("footprint"), 6).alias("area"))


@query("shd22_concave_roofs", """SELECT id, part, CAST(CASE WHEN part = 'wall' THEN 2 * n ELSE n - 2 END AS BIGINT) AS triangles, floor(1e6 * CASE WHEN part = 'wall' THEN p * h ELSE a END + 0.5) / 1e6 AS area FROM
  (SELECT id, max_z AS h, CASE WHEN id % 2 = 0 THEN 6 ELSE 8 END AS n, w * d * CASE WHEN id % 2 = 0 THEN 0.75e0 ELSE 0.875e0 END AS a, 2 * (w + d) + CASE WHEN id % 2 = 0 THEN 0 ELSE d END AS p FROM (SELECT *, max_x - min_x AS w, max_y - min_y AS d FROM obstacles)), (VALUES ('roof'), ('floor'), ('wall')) v(part)""", "obstacles")
def _(t: Tables) -> DataFrame:
    """Roofs, floors and walls over L shapes, and over U shapes that run clockwise."""
    from ..operators.spatial import RINGS, dealt

    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, x1, y1, cx, cy = (F.col(c) for c in ("min_x", "min_y", "max_x", "max_y", "center_x", "center_y"))
    ell = F.array(pt(x1, y0), pt(x1, cy), pt(cx, cy), pt(cx, y1), pt(x0, y1), pt(x0, y0))
    a, b = cx - (x1 - x0) / 8, cx + (x1 - x0) / 8
    u = F.array(pt(x0, y0), pt(x0, y1), pt(a, y1), pt(a, cy), pt(b, cy), pt(b, y1), pt(x1, y1), pt(x1, y0))
    o = dealt(t.obstacles(), RINGS).withColumn("ring", F.when(F.col("id") % 2 == 0, ell).otherwise(u)).select("id", F.explode(rings.extruded("ring", "min_z", "max_z")).alias("t"))
    return o.groupBy("id", "t.part").agg(F.count("*").alias("triangles"), half_up(F.sum(rings.triangle_area(F.col("t"))), 6).alias("area"))


@query("join23_polygon_tiles", """WITH r AS (SELECT *, max_x + 3e0 AS tip, (min_y + max_y) / 2 AS mid FROM obstacles) SELECT id, CAST(count(*) AS BIGINT) AS tiles, floor(sum(a) * 1e6 + 0.5) / 1e6 AS area FROM (SELECT id, te, tn, (least(max_x, te + 16) - greatest(min_x, te)) * (least(max_y, tn + 16) - greatest(min_y, tn)) AS a FROM r, range(-2, 80) x(i), range(-2, 60) y(j), (SELECT 1), LATERAL (SELECT i * 16e0 AS te, j * 16e0 AS tn) q
  WHERE te < max_x AND te + 16 > min_x AND tn < max_y AND tn + 16 > min_y) GROUP BY id""", "obstacles")
def _(t: Tables) -> DataFrame:
    from ..operators.spatial import polygons_in_tiles

    o = t.obstacles().select("id", F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y")))).alias("ring"))
    return polygons_in_tiles(o, 16.0).groupBy("id").agg(F.count("*").alias("tiles"), half_up(F.sum("shared"), 6).alias("area"))


@query("arr09_stitched_rings", "SELECT id, CAST(4 + id % 5 AS INTEGER) AS n, true AS closed FROM obstacles", "obstacles")
def _(t: Tables) -> DataFrame:
    """Rings of 4 to 8 corners, cut into ways of one or two edges, every other one turned round, joined again."""
    from ..operators.contours import stitched

    n, k = (4 + F.col("id") % 5).cast("int"), F.col("id")
    corner = lambda i: F.struct((F.col("center_x") + F.cos(i * 6.283185307179586 / n)).alias("x"), (F.col("center_y") + F.sin(i * 6.283185307179586 / n)).alias("y"))
    way = lambda i: F.transform(F.sequence(i, F.least(i + 2, n)), lambda q: corner(q % n))
    ways = F.transform(F.sequence(F.lit(0), n - 1, F.lit(2)), lambda i: F.struct(F.xxhash64(i, k).alias("ord"), F.when((i + k) % 4 < 2, way(i)).otherwise(F.reverse(way(i))).alias("points")))
    lines = t.obstacles().select("id", F.explode(ways).alias("w")).select("id", "w.ord", "w.points")
    return stitched(lines, "id").select("id", F.size("points").alias("n"), "closed")


@query("arr10_isolines", "WITH c AS (SELECT p_partkey % 61 AS i, p_partkey // 61 AS j, CASE WHEN p_size % 7 > 2 THEN 1 ELSE 0 END AS v FROM part), q AS (SELECT a.i, a.j, a.v + b.v + c2.v + d.v AS s, a.v = c2.v AND b.v = d.v AND a.v <> b.v AS saddle FROM c a JOIN c b ON b.i = a.i + 1 AND b.j = a.j JOIN c c2 ON c2.i = a.i + 1 AND c2.j = a.j + 1 JOIN c d ON d.i = a.i AND d.j = a.j + 1) SELECT i, j, CAST(CASE WHEN saddle THEN 2 ELSE 1 END AS BIGINT) AS lines, CASE WHEN saddle THEN sqrt(0.5e0) * 2 WHEN s = 2 THEN 1e0 ELSE sqrt(0.5e0) END AS length FROM q WHERE s BETWEEN 1 AND 3")
def _(t: Tables) -> DataFrame:
    from ..operators.contours import isolines

    k = F.col("p_partkey")
    cells = t.read("part").select((k % 61).alias("i"), F.floor(k / 61).alias("j"), (F.col("p_size") % 7 > 2).cast("double").alias("value"))
    a, b = F.col("points")[0], F.col("points")[1]
    length = F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))
    return isolines(cells).groupBy("i", "j").agg(F.count("*").alias("lines"), F.sum(length).alias("length"))


@query("flt12_point_in_ring", "SELECT o.id, p.probe FROM obstacles o JOIN probes p ON p.x > min_x AND p.x < max_x AND p.y > min_y AND p.y < max_y + 2 - abs(p.x - center_x) * 2 / (max_x - center_x)", "obstacles", "probes")
def _(t: Tables) -> DataFrame:
    from ..operators.spatial import boxes_with_points

    boxes = _ring(t).withColumn("max_y", F.col("max_y") + 2)
    return boxes_with_points(boxes, t.probes().select("probe", "x", "y")).where(rings.inside("ring", "x", "y")).select("id", "probe")


@query("shd12_ray_to_ring", "SELECT id, floor((min_x - (center_x - 100)) * 1e6 + 0.5) / 1e6 AS distance FROM obstacles", "obstacles")
def _(t: Tables) -> DataFrame:
    return _ring(t).select("id", half_up(rings.ray_to_ring("ring", F.col("center_x") - 100, F.col("center_y"), F.lit(1.0), F.lit(0.0)), 6).alias("distance"))


@query("shd13_ray_to_triangle", "SELECT p_partkey AS id, CASE WHEN x >= 0 AND y >= 0 AND x + y <= 10 THEN 5e0 END AS distance FROM (SELECT p_partkey, p_partkey % 13 + 0.25e0 AS x, p_size % 11 + 0.25e0 AS y FROM part)")
def _(t: Tables) -> DataFrame:
    z = F.lit(0.0)
    o = (F.col("p_partkey") % 13 + 0.25, F.col("p_size") % 11 + 0.25, F.lit(5.0))
    hit = rings.ray_to_triangle(o, (z, z, F.lit(-1.0)), (z, z, z), (F.lit(10.0), z, z), (z, F.lit(10.0), z))
    return t.read("part").select(F.col("p_partkey").alias("id"), hit.alias("distance"))


@query("arr07_without_repeats", "SELECT id, CAST(3 + id % 3 AS INTEGER) AS n, (3 + id % 3) * center_x AS sum_x FROM obstacles", "obstacles")
def _(t: Tables) -> DataFrame:
    """Rings of 3 to 5 corners, each one to four times in a row, closed by the first."""
    k = F.col("id")
    corner = lambda i: F.struct((F.col("center_x") + i * 2 - (3 + k % 3) + 1).alias("x"), (F.col("center_y") + i * i).alias("y"))
    many = F.flatten(F.transform(F.sequence(F.lit(0), (2 + k % 3).cast("int")), lambda i: F.array_repeat(corner(i), ((k + i) % 4 + 1).cast("int"))))
    clean = rings.without_repeats("many")
    out = t.obstacles().withColumn("many", F.concat(many, F.slice(many, 1, 1)))
    return out.select("id", F.size(clean).alias("n"), F.aggregate(clean, F.lit(0.0), lambda a, p: a + p["x"]).alias("sum_x"))


@query("arr08_without_collinear", "SELECT id, CAST(CASE WHEN id % 4 = 0 THEN 4 ELSE 5 END AS INTEGER) AS n, (max_x - min_x) * (max_y - min_y) + (max_x - min_x) * (CASE WHEN id % 4 = 0 THEN 0 ELSE 2 END) / 2 AS area FROM obstacles", "obstacles")
def _(t: Tables) -> DataFrame:
    """Houses with up to six points along the floor; every fourth has a flat roof, whose ridge point is on the eaves' line."""
    k = F.col("id")
    floor = F.transform(F.sequence(F.lit(0), (k % 6).cast("int")), lambda i: F.struct((F.col("min_x") + (F.col("max_x") - F.col("min_x")) * i / 8).alias("x"), F.col("min_y").alias("y")))
    flat = F.struct(F.col("center_x").alias("x"), F.col("max_y").alias("y"))
    ring = F.concat(floor, F.slice("ring", 2, 2), F.array(F.when(k % 4 == 0, flat).otherwise(F.col("ring")[3])), F.slice("ring", 5, 1))
    clean = rings.without_collinear("longer")
    return _ring(t).withColumn("longer", ring).select("id", F.size(clean).alias("n"), rings.area(clean).alias("area"))


@query("map01_tag_lookup", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events")
def _(t: Tables) -> DataFrame:
    tags = F.from_json("props", "map<string,bigint>")
    return t.events().select("event_id", F.coalesce(F.try_element_at(tags, F.lit("k")), F.lit(-1).cast("bigint")).alias("k"))


@query("map02_sorted_counts", "SELECT region, string_agg(priority || '=' || n, ',' ORDER BY priority) AS counts FROM (SELECT region, priority, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY region", "runs")
def _(t: Tables) -> DataFrame:
    from ..operators.places import histogram

    h = histogram(t.runs(), ["region"], "priority")
    return h.select("region", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("counts"))


@query("map03_inverted_index", "SELECT cx, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT id, CAST(floor(center_x / 64) AS BIGINT) AS cx FROM obstacles) GROUP BY cx", "obstacles")
def _(t: Tables) -> DataFrame:
    inv = t.obstacles().groupBy(F.floor(F.col("center_x") / 64).alias("cx")).agg(F.collect_set("id").alias("s"))
    return inv.select("cx", F.size("s").cast("bigint").alias("n"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ids"))


@query("jsn01_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t.events().select("event_id", F.from_json("props", "k int", {"mode": "FAILFAST"}).alias("p")).select("event_id", "p.k")


@query("jsn02_content_hash", """SELECT run, left(sha256('{"region":"' || region || '","run":' || run || '}'), 16) AS hash FROM runs""", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().select("run", F.substring(F.sha2(F.to_json(F.struct("region", "run")), 256), 1, 16).alias("hash"))


@query("jsn03_unknown_keys", "SELECT event_id, props AS raw, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t.events().select("event_id", F.col("props").alias("raw"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("jsn04_corrupt_rows", "SELECT count(*) FILTER (WHERE event_id % 9 = 0) AS corrupt, count(*) AS n FROM events")
def _(t: Tables) -> DataFrame:
    broken = F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    parsed = t.events().select(F.from_json(broken, "k int, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("p"))
    return parsed.agg(F.count_if(F.col("p._corrupt").isNotNull()).alias("corrupt"), F.count("*").alias("n"))


@query("snk07_geojson", """SELECT id, '{"type":"Feature","id":' || id || ',"properties":{"name":"' || name || '"}}' AS feature FROM places WHERE seating""", "places")
def _(t: Tables) -> DataFrame:
    feature = F.struct(F.lit("Feature").alias("type"), "id", F.struct("name").alias("properties"))
    return t.places().where("seating").select("id", F.to_json(feature).alias("feature"))


@query("snk10_release_manifest", "SELECT region, count(*) AS n, min(day) AS first, max(day) AS last FROM runs GROUP BY region", "runs")
def _(t: Tables) -> DataFrame:
    m = t.runs().groupBy("region").agg(F.map_from_entries(F.array(F.struct(F.lit("n"), F.count("*")))).alias("m"), F.min("day").alias("first"), F.max("day").alias("last"))
    return m.select("region", F.element_at("m", F.lit("n")).alias("n"), "first", "last")
