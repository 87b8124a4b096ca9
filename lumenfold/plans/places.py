"""Venue queries: filters, scores, rankings, search, opening hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hours, text
from ..functions.numbers import half_up
from ..operators import places as ops
from ..operators import checks, spatial, windows
from ..sources.tables import Tables
from .registry import query


@query("prj01_normalised_places", """SELECT 'osm:node:' || c_custkey AS id, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'park' ELSE 'terrace_candidate' END AS category,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'park' WHEN 'BUILDING' THEN 'cafe' WHEN 'MACHINERY' THEN 'bar' ELSE 'pub' END AS subcategory, c_acctbal > 5000 AS has_outdoor_seating, c_mktsegment <> 'FURNITURE' AND c_acctbal <= 0 AS unknown
  FROM customer WHERE c_mktsegment <> 'HOUSEHOLD' AND c_custkey % 10 <> 3""")
def _(t: Tables) -> DataFrame:
    c, seg = t.read("customer"), F.col("c_mktsegment")
    amenity = F.when(seg == "BUILDING", "cafe").when(seg == "MACHINERY", "bar").when(seg == "HOUSEHOLD", "bank").otherwise("pub")
    seats = F.when(F.col("c_acctbal") > 5000, "yes").when(F.col("c_acctbal") > 0, "no")
    kept = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    tags = F.map_from_entries(F.filter(F.array(kept("leisure", F.when(seg == "FURNITURE", "park")), kept("amenity", F.when(seg != "FURNITURE", amenity)), kept("outdoor_seating", seats)), lambda e: e["v"].isNotNull()))
    where = F.when(F.col("c_custkey") % 10 != 3, F.lit(46.5))
    e = c.select(F.lit("node").alias("type"), F.col("c_custkey").alias("id"), where.alias("lat"), where.alias("lon"), F.lit(None).cast("struct<lat:double,lon:double>").alias("center"), tags.alias("tags"))
    return ops.normalise(e, "r").select("id", "category", "subcategory", "has_outdoor_seating", F.col("has_outdoor_seating_unknown").alias("unknown"))


@query("prj02_venue_types", "SELECT id, CASE WHEN contains(lower(name), '7') THEN 'foodtruck' WHEN subcategory = 'bar' THEN 'bar' WHEN subcategory = 'fast_food' THEN 'snack' WHEN subcategory IN ('restaurant', 'cafe') THEN 'restaurant' ELSE 'other' END AS venue FROM places", "places")
def _(t: Tables) -> DataFrame:
    name = F.regexp_replace("name", "7", "truck")
    return t.places().select("id", ops.venue_type(name, F.col("subcategory")).alias("venue"))


@query("prj03_lite_places", "SELECT id, name, subcategory, CASE WHEN seating THEN lat END AS lat FROM places", "places")
def _(t: Tables) -> DataFrame:
    return t.places().select("id", "name", "subcategory", F.when(F.col("seating"), F.col("lat")).alias("lat"))


@query("flt04_place_filters", "SELECT id FROM places WHERE category = 'terrace_candidate' AND seating AND subcategory IN ('bar', 'cafe') AND lon BETWEEN 6.55e0 AND 6.7e0 AND lat BETWEEN 46.49e0 AND 46.5e0", "places")
def _(t: Tables) -> DataFrame:
    return ops.chosen(t.places(), "terrace_candidate", True, ("BAR", "Cafe"), box=(6.55, 46.49, 6.7, 46.5)).select("id")


@query("flt05_confirmed", "SELECT id FROM places WHERE category <> 'park' AND subcategory <> 'food_court' AND seating", "places")
def _(t: Tables) -> DataFrame:
    return ops.confirmed(t.places()).select("id")


@query("flt06_date_range", "SELECT run FROM runs WHERE day BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().where("day between date'1995-03-01' and date'1995-06-30'").select("run")


@query("flt07_manifest_filter", "SELECT run FROM runs WHERE region = 'F' AND priority = '1-URGENT' AND day >= DATE '1996-01-01'", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().where("region = 'F' and priority = '1-URGENT' and day >= date'1996-01-01'").select("run")


@query("flt10_group_filter", "SELECT run FROM runs WHERE priority IN ('1-URGENT', '2-HIGH')", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().where(F.col("priority").isin("1-URGENT", "2-HIGH")).select("run")


@query("flt11_obstacle_size", "SELECT id FROM (SELECT id, (max_x - min_x) / 8 AS w, (max_y - min_y) / 8 AS d, max_z / 20 AS h FROM obstacles) WHERE w >= 1 AND d >= 1 AND h >= 1 AND w * d >= 4", "obstacles")
def _(t: Tables) -> DataFrame:
    w, d = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return t.obstacles().select("*", (w / 8).alias("w"), (d / 8).alias("d"), (F.col("max_z") / 20).alias("h")).where(checks.large_enough("w", "d", "h")).select("id")


@query("flt17_visible_venues", "SELECT p.id, s.s_name AS timeline FROM places p LEFT JOIN supplier s ON s.s_suppkey = p.id WHERE seating AND subcategory = 'bar' AND lon BETWEEN 6.55e0 AND 6.7e0", "places")
def _(t: Tables) -> DataFrame:
    seen = ops.chosen(t.places(), seated=True, subcategories=("bar",)).where(F.col("lon").between(6.55, 6.7))
    return seen.join(t.read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("timeline")), "id", "left").select("id", "timeline")


@query("flt18_polyline_cut", "SELECT id FROM obstacles WHERE center_x <= CASE WHEN center_y <= 100 THEN 300 WHEN center_y <= 500 THEN 300 + (center_y - 100) * (700 - 300) / 400 ELSE 700 END", "obstacles")
def _(t: Tables) -> DataFrame:
    y = F.col("center_y")
    limit = F.when(y <= 100, 300.0).when(y <= 500, 300 + (y - 100) * (700 - 300) / 400).otherwise(700.0)
    return t.obstacles().where(F.col("center_x") <= limit).select("id")


@query("flt15_covered_view", "SELECT probe AS view, NOT EXISTS (SELECT 1 FROM range(9) a(i), range(9) b(j) WHERE NOT EXISTS (SELECT 1 FROM obstacles o WHERE x + i * 5 BETWEEN o.min_x - 8 AND o.max_x + 8 AND y + j * 5 BETWEEN o.min_y - 8 AND o.max_y + 8)) AS covered FROM probes", "probes", "obstacles")
def _(t: Tables) -> DataFrame:
    """A view at each probe is covered where rectangles held hold each of its 9 x 9 sample points."""
    steps = lambda: F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(5)))
    views = t.probes().select(F.col("probe").alias("view"), "x", "y")
    pts = views.withColumn("i", steps()).withColumn("j", steps()).select("view", (F.col("x") + F.col("i")).alias("x"), (F.col("y") + F.col("j")).alias("y"))
    held = t.obstacles().select(*((F.col(f"{end}_{c}") + by).alias(f"{end}_{c}") for end, by in (("min", -8), ("max", 8)) for c in "xy"))
    bare = spatial.outside_all(pts, held).groupBy("view").agg(F.count("*").alias("n"))
    return views.select("view").join(bare, "view", "left").select("view", F.col("n").isNull().alias("covered"))


@query("flt16_overlapping_recent", "SELECT id FROM obstacles WHERE min_x <= 500 AND max_x >= 200 ORDER BY id DESC LIMIT 25", "obstacles")
def _(t: Tables) -> DataFrame:
    return t.obstacles().where("min_x <= 500 and max_x >= 200").orderBy(F.desc("id")).limit(25).select("id")


@query("flt13_grid_guard", "SELECT count(*) > 1000 AS too_many FROM (SELECT 1 FROM places LIMIT 1001)", "places")
def _(t: Tables) -> DataFrame:
    return t.places().limit(1001).agg((F.count("*") > 1000).alias("too_many"))


@query("mth14_place_weight", "SELECT id, CASE WHEN category = 'park' THEN 3 ELSE 2 + CASE WHEN seating THEN 4 ELSE 0 END + CASE WHEN subcategory = 'bar' THEN 2 WHEN subcategory IN ('cafe', 'restaurant') THEN 1 ELSE 0 END END AS weight FROM places", "places")
def _(t: Tables) -> DataFrame:
    return t.places().select("id", ops.weight(F.col("category"), F.col("subcategory"), F.col("seating")).alias("weight"))


_SCORES = """s AS (SELECT *, CASE WHEN category = 'park' THEN 3 ELSE 2 + CASE WHEN seating THEN 4 ELSE 0 END + CASE WHEN subcategory = 'bar' THEN 2 WHEN subcategory IN ('cafe', 'restaurant') THEN 1 ELSE 0 END END AS w, CAST(floor(lon * 100) AS BIGINT) AS tile FROM places)"""


def _scored(t: Tables) -> DataFrame:
    return t.places().withColumn("tile", F.floor(F.col("lon") * 100))


@query("agg04_tile_scores", f"WITH {_SCORES} SELECT tile, CAST(sum(w) AS BIGINT) AS score, count(*) AS places, count(*) FILTER (WHERE seating) AS seated, count(*) FILTER (WHERE category = 'park') AS parks, list(name ORDER BY name, id)[1:8] AS names FROM s GROUP BY tile", "places")
def _(t: Tables) -> DataFrame:
    return ops.tile_scores(_scored(t), ["tile"])


@query("agg05_distinct_across_areas", "WITH a AS (SELECT CAST(floor(lon * 100) AS BIGINT) AS tile, id, k FROM places, range(3) r(k) WHERE id % (k + 2) = 0) SELECT tile, count(DISTINCT id) AS places FROM a GROUP BY tile", "places")
def _(t: Tables) -> DataFrame:
    each = _scored(t).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("id % (k + 2) = 0")
    return each.dropDuplicates(["tile", "id"]).groupBy("tile").agg(F.count("*").alias("places"))


@query("agg06_subcategory_histogram", f"WITH {_SCORES}, c AS (SELECT tile, subcategory, count(*) AS n FROM s GROUP BY 1, 2) SELECT tile, string_agg(subcategory || '=' || n, ',' ORDER BY subcategory) AS counts FROM c GROUP BY tile", "places")
def _(t: Tables) -> DataFrame:
    h = ops.histogram(_scored(t), ["tile"], "subcategory")
    return h.select("tile", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("counts"))


@query("agg01_category_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE category = 'park') AS parks, count(*) FILTER (WHERE seating) AS seated FROM places", "places")
def _(t: Tables) -> DataFrame:
    return t.places().agg(F.count("*").alias("total"), F.count_if(F.col("category") == "park").alias("parks"), F.count_if("seating").alias("seated"))


@query("agg02_global_box", "SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM places", "places")
def _(t: Tables) -> DataFrame:
    return t.places().agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


@query("agg03_last_file_wins", "SELECT owner AS id, arg_max(size, run) AS size FROM runs GROUP BY owner", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().groupBy(F.col("owner").alias("id")).agg(F.max_by("size", "run").alias("size"))


@query("agg36_clusters", "SELECT CAST(floor(center_x / 60) AS BIGINT) AS cx, CAST(floor(center_y / 60) AS BIGINT) AS cy, count(*) AS n, min(id) AS anchor FROM obstacles GROUP BY 1, 2", "obstacles")
def _(t: Tables) -> DataFrame:
    return ops.clusters(t.obstacles().withColumn("x", F.col("center_x")).withColumn("y", F.col("center_y")), 60)


@query("agg46_mode", "SELECT tile, arg_min(subcategory, (-n, f)) AS mode FROM (SELECT CAST(floor(lon * 100) AS BIGINT) AS tile, subcategory, count(*) AS n, min(id) AS f FROM places GROUP BY 1, 2) GROUP BY tile", "places")
def _(t: Tables) -> DataFrame:
    c = _scored(t).groupBy("tile", "subcategory").agg(F.count("*").alias("n"), F.min("id").alias("f"))
    return windows.first_by(c, ["tile"], [F.desc("n"), F.col("f")]).select("tile", F.col("subcategory").alias("mode"))


@query("win08_top_per_area", f"WITH {_SCORES}, g AS (SELECT tile, subcategory, CAST(sum(w) AS BIGINT) AS score, count(*) AS n FROM s GROUP BY 1, 2) SELECT * FROM (SELECT subcategory, tile, score, row_number() OVER (PARTITION BY subcategory ORDER BY score DESC, n DESC, tile) AS rank FROM g) WHERE rank <= 3", "places")
def _(t: Tables) -> DataFrame:
    w = ops.weight(F.col("category"), F.col("subcategory"), F.col("seating"))
    g = _scored(t).groupBy("tile", "subcategory").agg(F.sum(w).alias("score"), F.count("*").alias("n"))
    top = windows.first_by(g, ["subcategory"], [F.desc("score"), F.desc("n"), F.col("tile")], 3)
    return top.select("subcategory", "tile", "score", F.col("rank").cast("bigint").alias("rank"))


@query("win09_strict_then_backfill", "SELECT region, run FROM (SELECT region, run, row_number() OVER (PARTITION BY region ORDER BY priority = '1-URGENT' DESC, size DESC, run) AS r FROM runs) WHERE r <= 20", "runs")
def _(t: Tables) -> DataFrame:
    strict = F.col("priority") == "1-URGENT"
    return windows.first_by(t.runs(), ["region"], [strict.desc(), F.desc("size"), F.col("run")], 20).select("region", "run")


@query("win10_progress", "SELECT run, max(size) OVER (PARTITION BY region ORDER BY day, run ROWS UNBOUNDED PRECEDING) AS progress FROM runs", "runs")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("region").orderBy("day", "run").rowsBetween(Window.unboundedPreceding, 0)
    return t.runs().select("run", F.max("size").over(w).alias("progress"))


@query("win11_promote_current", "SELECT region, run, row_number() OVER (PARTITION BY region ORDER BY priority = '3-MEDIUM' DESC, run) AS pos FROM runs", "runs")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("region").orderBy((F.col("priority") == "3-MEDIUM").desc(), "run")
    return t.runs().select("region", "run", F.row_number().over(w).cast("bigint").alias("pos"))


@query("srt01_sunny_ranking", "SELECT id, sunny, name FROM (SELECT id, (id * 37) % 600 AS sunny, name FROM places) ORDER BY sunny DESC, name, id LIMIT 50", "places")
def _(t: Tables) -> DataFrame:
    return t.places().select("id", (F.col("id") * 37 % 600).alias("sunny"), "name").orderBy(F.desc("sunny"), "name", "id").limit(50)


@query("srt02_paged_runs", "SELECT run, size FROM runs WHERE region = 'O' ORDER BY size DESC, run LIMIT 25 OFFSET 50", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().where("region = 'O'").orderBy(F.desc("size"), "run").offset(50).limit(25).select("run", "size")


@query("srt03_tile_ranking", f"WITH {_SCORES} SELECT tile, CAST(sum(w) AS BIGINT) AS score FROM s GROUP BY tile ORDER BY score DESC, count(*) FILTER (WHERE seating) DESC, count(*) DESC, tile LIMIT 10", "places")
def _(t: Tables) -> DataFrame:
    return ops.tile_scores(_scored(t), ["tile"]).orderBy(F.desc("score"), F.desc("seated"), F.desc("places"), "tile").limit(10).select("tile", "score")


@query("srt08_priority_cut", "SELECT id, p AS priority FROM (SELECT id, CASE WHEN id % 10 = 0 THEN 0 WHEN seating THEN 1 ELSE 2 END AS p, row_number() OVER (ORDER BY CASE WHEN id % 10 = 0 THEN 0 WHEN seating THEN 1 ELSE 2 END, id) AS r FROM places) WHERE r <= 200", "places")
def _(t: Tables) -> DataFrame:
    p = F.when(F.col("id") % 10 == 0, 0).when(F.col("seating"), 1).otherwise(2)
    return t.places().select("id", p.alias("priority")).orderBy("priority", "id").limit(200)


@query("srt09_suggest", "SELECT id, score FROM (SELECT p_partkey AS id, p_name AS name, CASE WHEN starts_with(lower(p_name), 'pa') THEN 3 WHEN len(list_filter(regexp_split_to_array(lower(p_name), '[\\s\\-'']+'), lambda w: starts_with(w, 'pa'))) > 0 THEN 2 WHEN contains(lower(p_name), 'pa') THEN 1 ELSE 0 END AS score FROM part) WHERE score > 0 ORDER BY score DESC, name, id LIMIT 20")
def _(t: Tables) -> DataFrame:
    p = t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return ops.suggest(p, "pa").select("id", "score")


@query("str02_match_scores", "SELECT p_partkey AS id, CASE WHEN starts_with(lower(p_name), '1') THEN 3 WHEN len(list_filter(regexp_split_to_array(lower(p_name), '[\\s\\-'']+'), lambda w: starts_with(w, '1'))) > 0 THEN 2 WHEN contains(lower(p_name), '1') THEN 1 ELSE 0 END AS score FROM part")
def _(t: Tables) -> DataFrame:
    return t.read("part").select(F.col("p_partkey").alias("id"), text.match_score("p_name", F.lit("1")).alias("score"))


@query("srt10_keep_higher", "SELECT owner, max(size) AS size FROM runs GROUP BY owner", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().groupBy("owner").agg(F.max("size").alias("size")).orderBy(F.desc("size"), "owner")


@query("srt11_worst_ten", "SELECT run, size FROM runs ORDER BY size, run LIMIT 10", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().orderBy("size", "run").limit(10).select("run", "size")


@query("srt07_limit_before_compute", "SELECT id, floor(lat * 1e3 + 0.5) / 1e3 AS lat FROM (SELECT * FROM places ORDER BY id LIMIT 100)", "places")
def _(t: Tables) -> DataFrame:
    return t.places().orderBy("id").limit(100).select("id", half_up("lat", 3).alias("lat"))


_SPECS = ("24/7", "Mo-Fr 08:00-22:00", "Mo-Sa 08:00-12:00,14:00-18:30; Su off", "Fr-Mo 22:00-02:00", "sunrise-sunset")


def _specs(t: Tables) -> DataFrame:
    p = F.substring("priority", 1, 1).cast("int")
    return t.runs().select("run", F.element_at(F.array(*map(F.lit, _SPECS)), p).alias("spec"), (F.col("run") % 7).cast("int").alias("dow"), (F.col("run") * 13 % 1440).cast("int").alias("minute"))


_SPEC_SQL = """sp AS (SELECT run, CAST(left(priority, 1) AS INTEGER) AS k, CAST(run % 7 AS INTEGER) AS dow, CAST(run * 13 % 1440 AS INTEGER) AS minute FROM runs)"""


_TWICE = "08:00-12:00, 14:00-18:30"


@query("str10_open_status", f"""WITH {_SPEC_SQL} SELECT run, k <> 5 AS knowable, CASE k WHEN 1 THEN true WHEN 2 THEN dow BETWEEN 1 AND 5 AND minute >= 480 AND minute < 1320
  WHEN 3 THEN dow BETWEEN 1 AND 6 AND ((minute >= 480 AND minute < 720) OR (minute >= 840 AND minute < 1110)) WHEN 4 THEN dow IN (5, 6, 0, 1) AND minute >= 1320 ELSE false END AS is_open,
  CASE k WHEN 1 THEN 'open 24h'
    WHEN 2 THEN CASE dow WHEN 6 THEN 'closed, opens +2 08:00' WHEN 0 THEN 'closed, opens +1 08:00' ELSE CASE WHEN minute < 480 THEN 'closed, opens 08:00' WHEN minute < 1320 THEN 'open 08:00-22:00' ELSE 'closed, hours 08:00-22:00' END END
    WHEN 3 THEN CASE WHEN dow = 0 THEN 'closed, opens +1 08:00' WHEN minute < 480 THEN 'closed, opens 08:00' WHEN minute < 720 THEN 'open {_TWICE}' WHEN minute < 840 THEN 'closed, opens 14:00' WHEN minute < 1110 THEN 'open {_TWICE}' ELSE 'closed, hours {_TWICE}' END
    WHEN 4 THEN CASE WHEN dow BETWEEN 2 AND 4 THEN 'closed, opens +' || (5 - dow) || ' 22:00' WHEN minute < 1320 THEN 'closed, opens 22:00' ELSE 'open 22:00-24:00' END
    ELSE '' END AS label FROM sp""", "runs")
def _(t: Tables) -> DataFrame:
    s = hours.with_weeks(_specs(t), "spec").withColumn("s", hours.status("week", "dow", "minute"))
    return s.select("run", "s.knowable", "s.is_open", "s.label")


@query("str09_week_minutes", f"WITH {_SPEC_SQL} SELECT run, CASE k WHEN 1 THEN 10080 WHEN 2 THEN 5 * 840 WHEN 3 THEN 6 * 510 WHEN 4 THEN 4 * 120 END AS minutes FROM sp", "runs")
def _(t: Tables) -> DataFrame:
    day = lambda d: F.aggregate(F.coalesce(d["intervals"], F.array().cast("array<struct<start_min:int,end_min:int>>")), F.lit(0), lambda a, i: a + i["end_min"] - i["start_min"])
    return hours.with_weeks(_specs(t), "spec").select("run", F.aggregate("week", F.lit(0), lambda a, d: a + day(d)).alias("minutes"))


@query("win05_week_rows", f"WITH {_SPEC_SQL} SELECT run, CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 0 END::BIGINT AS rows FROM sp WHERE k < 5", "runs")
def _(t: Tables) -> DataFrame:
    w = hours.with_weeks(_specs(t), "spec", "w").where("w is not null")
    return w.select("run", F.size(hours.week_rows("w")).cast("bigint").alias("rows"))
