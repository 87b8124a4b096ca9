"""Comparators, orders, tile lookups and compositions of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import grids, index, windows
from ..sources.tables import Tables
from .registry import query


@query("srt04_top_priority", "SELECT run, priority, size FROM runs WHERE region = 'P' ORDER BY priority, size DESC, day, run LIMIT 30", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().where("region = 'P'").orderBy("priority", F.desc("size"), "day", "run").limit(30).select("run", "priority", "size")


@query("srt05_bucket_order", "SELECT tile, az_b, alt_b, row_number() OVER (PARTITION BY tile ORDER BY alt_b, az_b) AS pos FROM (SELECT DISTINCT tile, az_b, alt_b FROM buckets)", "buckets")
def _(t: Tables) -> DataFrame:
    b = t.buckets().select("tile", "az_b", "alt_b").distinct()
    return b.withColumn("pos", F.row_number().over(Window.partitionBy("tile").orderBy("alt_b", "az_b")).cast("bigint"))


@query("srt06_zone_order", "SELECT id, CAST(floor(center_x / 1000) AS BIGINT) AS zx, CAST(floor(center_y / 1000) AS BIGINT) AS zy FROM obstacles", "obstacles")
def _(t: Tables) -> DataFrame:
    """Obstacles dealt by 1 km zone, so that neighbours are written together."""
    zoned = t.obstacles().withColumn("zx", F.floor(F.col("center_x") / 1000)).withColumn("zy", F.floor(F.col("center_y") / 1000))
    return zoned.repartitionByRange("zx", "zy").sortWithinPartitions("zx", "zy", "id").select("id", "zx", "zy")


@query("srt12_bucket_lookup", "SELECT event_id, max(value2) AS value FROM (SELECT e.event_id, b.value AS value2 FROM events e JOIN buckets b ON b.tile = 1 AND b.az_b = e.event_id % 480 AND b.alt_b = 1 + e.event_id % 7) GROUP BY event_id", "buckets")
def _(t: Tables) -> DataFrame:
    keyed = t.events().select("event_id", (F.col("event_id") % 480).cast("int").alias("az_b"), (1 + F.col("event_id") % 7).cast("int").alias("alt_b"))
    return keyed.join(t.buckets().where("tile = 1").select("az_b", "alt_b", "value"), ["az_b", "alt_b"]).groupBy("event_id").agg(F.max("value").alias("value"))


@query("join03_box_to_tiles", "SELECT 'e' || (2538000 + 250 * i) || '_n' || (1152000 + 250 * j) || '_s250' AS tile_id FROM range(8) a(i), range(6) b(j) WHERE 250 * i <= 1130 AND 250 * i + 250 >= 240 AND 250 * j <= 700 AND 250 * j + 250 >= 260")
def _(t: Tables) -> DataFrame:
    """Tiles that meet a box of the plane, edges included."""
    cell = t.spark.range(48).select((F.floor(F.col("id") / 6) * 250).alias("x"), (F.col("id") % 6 * 250).alias("y"))
    met = cell.where((F.col("x") <= 1130) & (F.col("x") + 250 >= 240) & (F.col("y") <= 700) & (F.col("y") + 250 >= 260))
    return met.select(grids.tile_id(2_538_000 + F.col("x"), 1_152_000 + F.col("y"), 250).alias("tile_id"))


@query("join18_place_timelines", """WITH w AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY ts, ord) - row_number() OVER (PARTITION BY point, is_sunny ORDER BY ts, ord) AS isl FROM samples), win AS (SELECT point, count(*) * 15 AS minutes FROM w WHERE is_sunny GROUP BY point, isl)
  SELECT p.id, count(win.point) AS n, CAST(coalesce(sum(minutes), 0) AS BIGINT) AS minutes FROM places p LEFT JOIN win ON win.point = p.id % 200 WHERE p.seating GROUP BY p.id""", "samples", "places")
def _(t: Tables) -> DataFrame:
    """Seated venues with the sunny windows of the point that each stands on."""
    per = windows.sunny_windows(t.samples(), 15).groupBy("point").agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"))
    p = t.places().where("seating").select("id", (F.col("id") % 200).alias("point"))
    return p.join(per, "point", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("minutes", F.lit(0)).alias("minutes"))


@query("agg16_storage", "SELECT region, count(*) AS files, CAST(sum(CAST(floor(size) AS BIGINT)) AS BIGINT) AS bytes FROM runs GROUP BY region", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().groupBy("region").agg(F.count("*").alias("files"), F.sum(F.floor("size")).alias("bytes"))


@query("agg38_orphan_sizes", "SELECT region, CAST(sum(CAST(floor(size) AS BIGINT)) AS BIGINT) AS bytes FROM runs WHERE owner NOT IN (SELECT id FROM places WHERE seating) GROUP BY region", "runs", "places")
def _(t: Tables) -> DataFrame:
    known = t.places().where("seating").select(F.col("id").alias("owner"))
    return t.runs().join(known, "owner", "left_anti").groupBy("region").agg(F.sum(F.floor("size")).alias("bytes"))


@query("src15_pruned_index", "SELECT tile, az_b, alt_b, count(*) AS n FROM buckets WHERE (az_b, alt_b) IN ((5, 1), (6, 2), (7, 3)) GROUP BY 1, 2, 3", "buckets")
def _(t: Tables) -> DataFrame:
    wanted = [(5, 1), (6, 2), (7, 3)]
    hit = F.struct("az_b", "alt_b").isin(*(F.struct(F.lit(a), F.lit(b)) for a, b in wanted))
    return t.buckets().where(F.col("alt_b").between(1, 3) & hit).groupBy("tile", "az_b", "alt_b").agg(F.count("*").alias("n"))


@query("src19_ranked_hashes", "SELECT region, priority AS hash, n AS runs, row_number() OVER (PARTITION BY region ORDER BY priority = '4-NOT SPECIFIED' DESC, n DESC, priority) AS rank FROM (SELECT region, priority, count(*) AS n FROM runs GROUP BY 1, 2)", "runs")
def _(t: Tables) -> DataFrame:
    from ..sources.readers import ranked_hashes

    ranked = ranked_hashes(t.runs().select("region", F.col("priority").alias("hash")), "4-NOT SPECIFIED")
    return ranked.select("region", "hash", "runs", F.col("rank").cast("bigint").alias("rank"))


@query("agg23_buckets_by_user", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, floor(value * 10) AS az_b, floor(value) AS alt_b FROM events WHERE value > 0) GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    pos = t.events().select("user_id", (F.col("value") * 10).alias("azimuth"), F.col("value").alias("altitude"))
    return index.target_buckets(pos, 1.0, ("user_id",)).groupBy("user_id").agg(F.count("*").alias("n"))
