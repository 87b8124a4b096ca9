"""Sun positions, angle buckets, the angle index and windows over samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sun
from ..functions.numbers import half_up
from ..operators import index, windows
from ..sources.tables import LAT, LON, Tables
from .registry import query

_SUN = f"""s0 AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, epoch_us(CAST(ts AS TIMESTAMP)) / 86400000000e0 - 10957.5e0 AS d FROM events),
s1 AS (SELECT *, radians(357.5291e0 + 0.98560028e0 * d) AS m FROM s0),
s2 AS (SELECT *, m + radians(1.9148e0 * sin(m) + 0.02e0 * sin(2 * m) + 0.0003e0 * sin(3 * m)) + radians(102.9372e0) + pi() AS l FROM s1),
s3 AS (SELECT *, asin(greatest(-1e0, least(1e0, sin(radians(23.4397e0)) * sin(l)))) AS dec, atan2(sin(l) * cos(radians(23.4397e0)), cos(l)) AS ra FROM s2),
s4 AS (SELECT *, radians(280.16e0 + 360.9856235e0 * d) + radians({LON}e0) - ra AS h, radians({LAT}e0) AS phi FROM s3),
sunpos AS (SELECT event_id, user_id, ts, d, degrees(atan2(sin(h), cos(h) * sin(phi) - tan(dec) * cos(phi))) + 180 AS az0,
  degrees(asin(greatest(-1e0, least(1e0, sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(h))))) AS altitude FROM s4),
sun AS (SELECT event_id, user_id, ts, CASE WHEN az0 >= 360 THEN az0 - 360 WHEN az0 < 0 THEN az0 + 360 ELSE az0 END AS azimuth, altitude FROM sunpos)"""


def _sun(t: Tables) -> DataFrame:
    return t.events().withColumn("s", sun.sun_position("ts", LAT, LON)).select("event_id", "user_id", "ts", "s.azimuth", "s.altitude")


@query("shd01_sun_position", f"WITH {_SUN} SELECT event_id, floor(azimuth * 1e6 + 0.5) / 1e6 AS azimuth, floor(altitude * 1e6 + 0.5) / 1e6 AS altitude FROM sun")
def _(t: Tables) -> DataFrame:
    return _sun(t).select("event_id", half_up("azimuth", 6).alias("azimuth"), half_up("altitude", 6).alias("altitude"))


@query("flt08_above_horizon", f"WITH {_SUN} SELECT event_id FROM sun WHERE altitude > 0")
def _(t: Tables) -> DataFrame:
    return _sun(t).where("altitude > 0").select("event_id")


@query("mth08_bucket_keys", f"WITH {_SUN} SELECT event_id, (CAST(floor(altitude / 0.75e0) AS BIGINT) << 16) | CAST(floor(azimuth / 0.75e0) AS BIGINT) AS key FROM sun WHERE altitude > 0")
def _(t: Tables) -> DataFrame:
    return _sun(t).where("altitude > 0").select("event_id", sun.bucket_key(sun.bucket("azimuth", 0.75), sun.bucket("altitude", 0.75)).alias("key"))


@query("shd04_horizon_lookup", f"WITH {_SUN} SELECT event_id, az_bin, floor(altitude * 1e6 + 0.5) / 1e6 <= angle AS blocked FROM sun JOIN horizon ON az_bin = CAST(floor(azimuth + 0.5) AS INTEGER) % 360", "horizon")
def _(t: Tables) -> DataFrame:
    at = _sun(t).withColumn("az_bin", sun.azimuth_bin("azimuth"))
    return index.horizon_blocked(at.withColumn("altitude", half_up("altitude", 6)), t.horizon()).select("event_id", "az_bin", "blocked")


@query(
    "shd02_verdict",
    f"""WITH {_SUN}, v AS (SELECT event_id, altitude > 0 AS above, floor(altitude * 1e6 + 0.5) / 1e6 <= angle AS hz, event_id % 7 = 0 AS tr, event_id % 5 = 0 AS bd, event_id % 3 = 0 AS vg
      FROM sun JOIN horizon ON az_bin = CAST(floor(azimuth + 0.5) AS INTEGER) % 360)
    SELECT event_id, above AND (hz OR tr) AS terrain_blocked, above AND NOT (hz OR tr) AND bd AS buildings_blocked, above AND NOT (hz OR tr) AND vg AS vegetation_blocked,
      above AND NOT hz AND NOT tr AND NOT bd AND NOT vg AS is_sunny FROM v""",
    "horizon",
)
def _(t: Tables) -> DataFrame:
    at = index.horizon_blocked(_sun(t).withColumn("az_bin", sun.azimuth_bin("azimuth")).withColumn("altitude", half_up("altitude", 6)), t.horizon())
    v = sun.verdict(F.col("altitude") > 0, F.col("blocked"), F.col("event_id") % 7 == 0, F.col("event_id") % 5 == 0, F.col("event_id") % 3 == 0)
    return at.select("event_id", v.alias("v")).select("event_id", "v.*")


@query(
    "shd03_all_blockers",
    f"""WITH {_SUN} SELECT count(*) AS n, sum(CASE WHEN altitude > 0 AND event_id % 5 = 0 THEN 1 ELSE 0 END) AS built, sum(CASE WHEN altitude > 0 AND event_id % 7 = 0 THEN 1 ELSE 0 END) AS terrain FROM sun""",
)
def _(t: Tables) -> DataFrame:
    v = sun.verdict(F.col("altitude") > 0, F.lit(False), F.col("event_id") % 7 == 0, F.col("event_id") % 5 == 0, F.lit(False), all_blockers=True)
    return _sun(t).select(v.alias("v")).agg(F.count("*").alias("n"), F.sum(F.col("v.buildings_blocked").cast("int")).alias("built"), F.sum(F.col("v.terrain_blocked").cast("int")).alias("terrain"))


@query("mth06_normal_azimuth", "SELECT event_id, (value + 180) % 360 AS azimuth FROM events WHERE value >= 0")
def _(t: Tables) -> DataFrame:
    return t.events().where("value >= 0").select("event_id", sun.normal_azimuth("value").alias("azimuth"))


@query("mth20_shadow_length", "SELECT p_partkey AS id, floor((5 + p_size) / tan(radians(5 + p_partkey % 80)) * 1e6 + 0.5) / 1e6 AS metres FROM part")
def _(t: Tables) -> DataFrame:
    return t.read("part").select(F.col("p_partkey").alias("id"), half_up(sun.shadow_length(5 + F.col("p_size"), 5 + F.col("p_partkey") % 80), 6).alias("metres"))


_DAYS = """g AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), d0 AS (SELECT day, epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR) / 86400000000e0 - 10957.5e0 AS d, -radians({lon}e0) AS w, radians({lat}e0) AS phi FROM g),
d1 AS (SELECT *, floor(d - 0.0009e0 - w / (2 * pi()) + 0.5) AS cyc FROM d0), d2 AS (SELECT *, 0.0009e0 + w / (2 * pi()) + cyc AS t0 FROM d1),
d3 AS (SELECT *, radians(357.5291e0 + 0.98560028e0 * t0) AS m FROM d2), d4 AS (SELECT *, m + radians(1.9148e0 * sin(m) + 0.02e0 * sin(2 * m) + 0.0003e0 * sin(3 * m)) + radians(102.9372e0) + pi() AS l FROM d3),
d5 AS (SELECT *, 0.0053e0 * sin(m) - 0.0069e0 * sin(2 * l) AS c, asin(sin(radians(23.4397e0)) * sin(l)) AS dec FROM d4),
d6 AS (SELECT *, t0 + c AS noon, acos((sin(radians(-0.833e0)) - sin(phi) * sin(dec)) / (cos(phi) * cos(dec))) AS a FROM d5),
d7 AS (SELECT *, 0.0009e0 + (a + w) / (2 * pi()) + cyc + c AS down FROM d6)""".format(lat=LAT, lon=LON)


@query(
    "dt06_sunrise_sunset",
    f"WITH {_DAYS} SELECT day, CAST(floor((2 * noon - down + 10957.5e0) * 86400 + 0.5) AS BIGINT) AS sunrise, CAST(floor((down + 10957.5e0) * 86400 + 0.5) AS BIGINT) AS sunset FROM d7",
)
def _(t: Tables) -> DataFrame:
    days = t.events().select(F.to_date("ts").alias("day")).distinct()
    s = sun.sunrise_and_sunset(F.col("day").cast("timestamp") + F.expr("interval 12 hours"), LAT, LON)
    seconds = lambda c: F.floor(F.unix_micros(c) / 1e6 + 0.5).cast("bigint")
    return days.withColumn("s", s).select("day", seconds("s.sunrise").alias("sunrise"), seconds("s.sunset").alias("sunset"))


@query(
    "mth19_first_last_rays",
    f"WITH {_DAYS} SELECT day, CAST(floor((2 * noon - down + 10957.5e0) * 86400 + 0.5) AS BIGINT) + 1800 AS first_rays, CAST(floor((down + 10957.5e0) * 86400 + 0.5) AS BIGINT) - 2700 AS last_rays FROM d7",
)
def _(t: Tables) -> DataFrame:
    days = t.events().select(F.to_date("ts").alias("day")).distinct()
    s = sun.sunrise_and_sunset(F.col("day").cast("timestamp") + F.expr("interval 12 hours"), LAT, LON)
    seconds = lambda c: F.floor(F.unix_micros(c) / 1e6 + 0.5).cast("bigint")
    rays = days.withColumn("s", s)
    return rays.select("day", seconds(F.col("s.sunrise") + F.expr("interval 30 minutes")).alias("first_rays"), seconds(F.col("s.sunset") - F.expr("interval 45 minutes")).alias("last_rays"))


_RUNS = """w AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY ts, ord) - row_number() OVER (PARTITION BY point, is_sunny ORDER BY ts, ord) AS island,
  coalesce(lead(ts) OVER (PARTITION BY point ORDER BY ts, ord), ts + INTERVAL 15 MINUTE) AS nxt FROM samples),
win AS (SELECT point, min(ts) AS start, max(nxt) AS "end", count(*) * 15 AS minutes FROM w WHERE is_sunny GROUP BY point, island)"""


@query("win01_sunny_windows", f'WITH {_RUNS} SELECT point, start, "end", minutes FROM win', "samples")
def _(t: Tables) -> DataFrame:
    return windows.sunny_windows(t.samples(), 15)


@query("agg08_sunny_minutes", f"WITH {_RUNS} SELECT point, CAST(sum(minutes) AS BIGINT) AS minutes, count(*) AS n FROM win GROUP BY point", "samples")
def _(t: Tables) -> DataFrame:
    return windows.sunny_windows(t.samples(), 15).groupBy("point").agg(F.sum("minutes").alias("minutes"), F.count("*").alias("n"))


@query("win02_first_last_sun", f"""WITH {_RUNS} SELECT point, CAST(start AS DATE) AS day, strftime(min(start), '%H:%M') AS first_sun, strftime(max("end"), '%H:%M') AS last_sun FROM win GROUP BY 1, 2""", "samples")
def _(t: Tables) -> DataFrame:
    w = windows.sunny_windows(t.samples(), 15)
    return w.groupBy("point", F.to_date("start").alias("day")).agg(F.date_format(F.min("start"), "HH:mm").alias("first_sun"), F.date_format(F.max("end"), "HH:mm").alias("last_sun"))


@query("agg07_frame_counts", "SELECT ts, count(*) AS points, CAST(sum(CASE WHEN is_sunny THEN 1 ELSE 0 END) AS BIGINT) AS sunny FROM samples GROUP BY ts", "samples")
def _(t: Tables) -> DataFrame:
    return t.samples().groupBy("ts").agg(F.count("*").alias("points"), F.count_if("is_sunny").alias("sunny"))


@query("agg12_exposure", "SELECT point, floor(avg(CASE WHEN is_sunny THEN 1e0 ELSE 0e0 END) * 1e9 + 0.5) / 1e9 AS exposure FROM samples GROUP BY point", "samples")
def _(t: Tables) -> DataFrame:
    return t.samples().groupBy("point").agg(half_up(F.avg(F.col("is_sunny").cast("double")), 9).alias("exposure"))


@query("agg10_daily_windows", f"""WITH {_RUNS} SELECT point, CAST(start AS DATE) AS day, count(*) AS n, CAST(sum(minutes) AS BIGINT) AS minutes, max(minutes) AS longest FROM win GROUP BY 1, 2""", "samples")
def _(t: Tables) -> DataFrame:
    w = windows.sunny_windows(t.samples(), 15)
    return w.groupBy("point", F.to_date("start").alias("day")).agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"), F.max("minutes").alias("longest"))


@query("agg09_instant_area", "SELECT count(*) AS points, CAST(sum(CASE WHEN is_sunny THEN 1 ELSE 0 END) AS BIGINT) AS sunny, CAST(sum(CASE WHEN is_sunny THEN 0 ELSE 1 END) AS BIGINT) AS shaded FROM (SELECT point, arg_max(is_sunny, (ts, ord)) AS is_sunny FROM samples WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY point)", "samples")
def _(t: Tables) -> DataFrame:
    now = t.samples().where("ts <= timestamp'2024-01-15 12:00:00'").groupBy("point").agg(F.max_by("is_sunny", F.struct("ts", "ord")).alias("is_sunny"))
    return now.agg(F.count("*").alias("points"), F.count_if("is_sunny").alias("sunny"), F.count_if(~F.col("is_sunny")).alias("shaded"))


@query("agg13_hours_by_month", "SELECT point, CAST(month(ts) AS INTEGER) AS month, CAST(sum(CASE WHEN is_sunny THEN 15 ELSE 0 END) AS BIGINT) / 60 AS hours FROM samples GROUP BY 1, 2", "samples")
def _(t: Tables) -> DataFrame:
    return t.samples().groupBy("point", F.month("ts").alias("month")).agg((F.sum(F.when(F.col("is_sunny"), 15).otherwise(0)) / 60).alias("hours"))


@query("agg31_slot_average", """WITH g AS (SELECT CAST(floor((hour(ts) * 60 + minute(ts)) / 15) AS INTEGER) AS slot, avg(CASE WHEN is_sunny THEN 1e0 ELSE 0e0 END) AS r, count(*) AS n FROM samples GROUP BY 1)
  SELECT slot, n, floor(r * 1e9 + 0.5) / 1e9 AS ratio, slot = (SELECT max(slot) FROM g WHERE r >= 0.1) AS is_last FROM g""", "samples")
def _(t: Tables) -> DataFrame:
    slot = F.floor((F.hour("ts") * 60 + F.minute("ts")) / 15).cast("int")
    g = t.samples().groupBy(slot.alias("slot")).agg(F.avg(F.col("is_sunny").cast("double")).alias("r"), F.count("*").alias("n"))
    last = F.max(F.when(F.col("r") >= 0.1, F.col("slot"))).over(Window.partitionBy(F.lit(0)))
    return g.select("slot", "n", half_up("r", 9).alias("ratio"), (F.col("slot") == last).alias("is_last"))


@query("win04_last_slot_by_threshold", """WITH g AS (SELECT CAST(hour(ts) AS INTEGER) AS slot, avg(CASE WHEN is_sunny THEN 1e0 ELSE 0e0 END) AS r FROM samples GROUP BY 1)
  SELECT th AS threshold, max(slot) AS slot FROM g, (VALUES (10), (50), (80)) v(th) WHERE r * 100 >= th GROUP BY th""", "samples")
def _(t: Tables) -> DataFrame:
    g = t.samples().groupBy(F.hour("ts").alias("slot")).agg(F.avg(F.col("is_sunny").cast("double")).alias("r"))
    each = g.withColumn("threshold", F.explode(F.array(*map(F.lit, (10, 50, 80))))).where("r * 100 >= threshold")
    return each.groupBy("threshold").agg(F.max("slot").alias("slot"))


@query("agg23_distinct_buckets", f"WITH {_SUN} SELECT DISTINCT CAST(floor(azimuth / 0.75e0) AS INTEGER) AS az_b, CAST(floor(altitude / 0.75e0) AS INTEGER) AS alt_b FROM sun WHERE altitude > 0")
def _(t: Tables) -> DataFrame:
    return index.target_buckets(_sun(t), 0.75)


@query("agg24_dedup_factor", " UNION ALL ".join(
    f"SELECT * FROM (WITH {_SUN} SELECT {r}e0 AS resolution, count(*) AS frames, count(DISTINCT (floor(azimuth / {r}e0), floor(altitude / {r}e0))) AS buckets FROM sun WHERE altitude > 0)" for r in (0.5, 1.0, 2.0)))
def _(t: Tables) -> DataFrame:
    return index.dedup_factor(_sun(t), (0.5, 1.0, 2.0)).drop("factor")


@query("agg22_bucket_representative", """SELECT tile, az_b, alt_b, arg_min(value, (d, ord, line, value)) AS value, min(d) AS distance FROM (SELECT *, abs(value - 25) AS d FROM buckets) GROUP BY 1, 2, 3""", "buckets")
def _(t: Tables) -> DataFrame:
    b = t.buckets().withColumn("d", F.abs(F.col("value") - 25))
    return b.groupBy("tile", "az_b", "alt_b").agg(F.min_by("value", F.struct("d", "ord", "line", "value")).alias("value"), F.min("d").alias("distance"))


@query("win14_ranked_candidates", """SELECT tile, az_b, alt_b, ord, line, rank, rank = 1 AS is_winner FROM (SELECT *, row_number() OVER (PARTITION BY tile, az_b, alt_b ORDER BY abs(value - 25), version, ord, line) AS rank FROM buckets) WHERE rank <= 3""", "buckets")
def _(t: Tables) -> DataFrame:
    got = windows.first_by(t.buckets(), ["tile", "az_b", "alt_b"], [F.abs(F.col("value") - 25), F.col("version"), F.col("ord"), F.col("line")], 3)
    return got.select("tile", "az_b", "alt_b", "ord", "line", F.col("rank").cast("bigint").alias("rank"), (F.col("rank") == 1).alias("is_winner"))


_OLD_NEW = """old AS (SELECT * FROM buckets WHERE version < TIMESTAMP '1997-01-01'), new AS (SELECT * FROM buckets WHERE version >= TIMESTAMP '1997-01-01')"""


@query("set04_upsert", f"""WITH {_OLD_NEW}, u AS (SELECT *, 0 AS src FROM new UNION ALL SELECT *, 1 AS src FROM old)
  SELECT tile, az_b, alt_b, src, ord, line, value FROM (SELECT *, row_number() OVER (PARTITION BY tile, az_b, alt_b ORDER BY src, ord, line, value) AS r FROM u) WHERE r = 1""", "buckets")
def _(t: Tables) -> DataFrame:
    b = t.buckets()
    cut = F.lit("1997-01-01").cast("timestamp")
    return index.upsert(b.where(F.col("version") < cut), b.where(F.col("version") >= cut), ["tile", "az_b", "alt_b"], ["ord", "line", "value"]).select("tile", "az_b", "alt_b", "src", "ord", "line", "value")


@query("set05_width_drift", f"""WITH {_OLD_NEW}, ow AS (SELECT tile, count(DISTINCT az_b) AS w FROM old GROUP BY 1), nw AS (SELECT tile, count(DISTINCT az_b) AS w FROM new GROUP BY 1),
  bad AS (SELECT tile FROM ow JOIN nw USING (tile) WHERE ow.w <> nw.w), u AS (SELECT *, 0 AS src FROM new UNION ALL SELECT *, 1 AS src FROM old WHERE tile NOT IN (SELECT tile FROM bad))
  SELECT tile, az_b, alt_b, src, ord, line FROM (SELECT *, row_number() OVER (PARTITION BY tile, az_b, alt_b ORDER BY src, ord, line) AS r FROM u) WHERE r = 1""", "buckets")
def _(t: Tables) -> DataFrame:
    b = t.buckets()
    cut = F.lit("1997-01-01").cast("timestamp")
    old, new = b.where(F.col("version") < cut), b.where(F.col("version") >= cut)
    width = lambda d: d.groupBy("tile").agg(F.countDistinct("az_b").alias("w"))
    old = index.without_drifted(old, width(old), width(new), "tile")
    return index.upsert(old, new, ["tile", "az_b", "alt_b"], ["ord", "line"]).select("tile", "az_b", "alt_b", "src", "ord", "line")


@query("set01_union_buckets", "SELECT DISTINCT az_b, alt_b FROM buckets WHERE tile IN (1, 2)", "buckets")
def _(t: Tables) -> DataFrame:
    b = t.buckets().select("tile", "az_b", "alt_b")
    return b.where("tile = 1").drop("tile").union(b.where("tile = 2").drop("tile")).distinct()


@query("join15_missing_buckets", "SELECT DISTINCT az_b, alt_b FROM buckets WHERE tile = 1 AND (az_b, alt_b) NOT IN (SELECT (az_b, alt_b) FROM buckets WHERE tile = 2)", "buckets")
def _(t: Tables) -> DataFrame:
    b = t.buckets().select("tile", "az_b", "alt_b")
    return index.missing_buckets(b.where("tile = 1").drop("tile"), b.where("tile = 2").drop("tile"))


@query("set02_except", "SELECT az_b FROM buckets WHERE tile = 1 EXCEPT SELECT az_b FROM buckets WHERE tile = 2", "buckets")
def _(t: Tables) -> DataFrame:
    b = t.buckets().select("tile", "az_b")
    return b.where("tile = 1").select("az_b").subtract(b.where("tile = 2").select("az_b"))


@query("set03_intersect", "SELECT az_b FROM buckets WHERE tile = 1 INTERSECT SELECT az_b FROM buckets WHERE tile = 2", "buckets")
def _(t: Tables) -> DataFrame:
    b = t.buckets().select("tile", "az_b")
    return b.where("tile = 1").select("az_b").intersect(b.where("tile = 2").select("az_b"))


@query("set08_coverage", """WITH need AS (SELECT DISTINCT az_b FROM buckets WHERE tile = 1), tiles AS (SELECT DISTINCT tile FROM buckets), have AS (SELECT DISTINCT tile, az_b FROM buckets)
  SELECT tile, count(h.az_b) AS present, count(*) AS needed, count(h.az_b) = count(*) AS covered FROM tiles CROSS JOIN need LEFT JOIN have h USING (tile, az_b) GROUP BY tile""", "buckets")
def _(t: Tables) -> DataFrame:
    b = t.buckets().select("tile", "az_b")
    return index.coverage(b, b.where("tile = 1").select("az_b"), "tile", ["az_b"])


@query("join12_resolution_cascade", f"""WITH {_SUN}, s AS (SELECT event_id, azimuth FROM sun WHERE altitude > 0),
  a AS (SELECT az_b, max(value) AS v FROM buckets WHERE tile = 1 AND az_b % 3 = 0 GROUP BY 1), b AS (SELECT az_b, max(value) AS v FROM buckets WHERE tile = 2 AND az_b % 2 = 0 GROUP BY 1), c AS (SELECT az_b, max(value) AS v FROM buckets WHERE tile = 3 GROUP BY 1)
  SELECT event_id, coalesce(a.v, b.v, c.v) AS value, CASE WHEN a.v IS NOT NULL THEN 0.5 WHEN b.v IS NOT NULL THEN 0.75 WHEN c.v IS NOT NULL THEN 1.0 END::DOUBLE AS resolution
  FROM s LEFT JOIN a ON a.az_b = floor(azimuth / 0.5e0) LEFT JOIN b ON b.az_b = floor(azimuth / 0.75e0) LEFT JOIN c ON c.az_b = floor(azimuth / 1e0)""", "buckets")
def _(t: Tables) -> DataFrame:
    b = t.buckets()
    top = lambda d: d.groupBy("az_b").agg(F.max("value").alias("v"))
    levels = {0.5: top(b.where("tile = 1 and az_b % 3 = 0")), 0.75: top(b.where("tile = 2 and az_b % 2 = 0")), 1.0: top(b.where("tile = 3"))}
    return index.cascade(_sun(t).where("altitude > 0").select("event_id", "azimuth"), levels, "azimuth", "az_b", "v").select("event_id", F.col("v").alias("value"), "resolution")


@query("join26_ridge_point", f"WITH {_SUN} SELECT event_id, angle FROM sun JOIN horizon ON az_bin = CAST(floor(azimuth + 0.5) AS INTEGER) % 360 WHERE altitude > 0", "horizon")
def _(t: Tables) -> DataFrame:
    return _sun(t).where("altitude > 0").withColumn("az_bin", sun.azimuth_bin("azimuth")).join(t.horizon(), "az_bin").select("event_id", "angle")


@query("arr06_horizon_max", "SELECT max(angle) AS max_angle, count(*) AS bins FROM horizon", "horizon")
def _(t: Tables) -> DataFrame:
    mask = t.horizon().agg(F.collect_list("angle").alias("bins"))
    return mask.select(F.array_max("bins").alias("max_angle"), F.size("bins").cast("bigint").alias("bins"))


@query("agg26_divergence_by_band", f"""WITH {_SUN} SELECT CAST(floor(altitude / 10) AS INTEGER) AS band, count(*) AS n, CAST(sum(CASE WHEN (event_id % 3 = 0) <> (event_id % 5 = 0) THEN 1 ELSE 0 END) AS BIGINT) AS differing FROM sun WHERE altitude > 0 GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    s = _sun(t).where("altitude > 0").withColumn("differs", (F.col("event_id") % 3 == 0) != (F.col("event_id") % 5 == 0))
    return s.groupBy(F.floor(F.col("altitude") / 10).cast("int").alias("band")).agg(F.count("*").alias("n"), F.count_if("differs").alias("differing"))


@query("flt09_suspicious_zero_frames", f"""WITH {_SUN}, f AS (SELECT CAST(ts AS DATE) AS day, max(altitude) AS alt, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS sunny FROM sun GROUP BY 1, hour(ts)) SELECT day, count(*) AS kept FROM f WHERE NOT (alt > 2 AND sunny = 0) GROUP BY day""")
def _(t: Tables) -> DataFrame:
    f = _sun(t).groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("h")).agg(F.max("altitude").alias("alt"), F.count_if(F.col("event_id") % 2 == 0).alias("sunny"))
    return f.where(~((F.col("alt") > 2) & (F.col("sunny") == 0))).groupBy("day").agg(F.count("*").alias("kept"))


@query("shd05_horizon_margin", f"WITH {_SUN} SELECT count(*) AS n FROM sun WHERE altitude > (SELECT max(angle) FROM horizon) + 0.25 - 12", "horizon")
def _(t: Tables) -> DataFrame:
    top = t.horizon().agg(F.max("angle").alias("top"))
    return _sun(t).join(F.broadcast(top), F.col("altitude") > F.col("top") + 0.25 - 12).agg(F.count("*").alias("n"))


@query("win03_equal_bucket_runs", """WITH d AS (SELECT DISTINCT az_b, CAST(version AS DATE) AS day FROM buckets WHERE tile = 1), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY az_b ORDER BY day) AS INTEGER) AS isl FROM d)
  SELECT az_b, day, count(*) OVER (PARTITION BY az_b, isl) - row_number() OVER (PARTITION BY az_b, isl ORDER BY day) + 1 AS forward FROM i""", "buckets")
def _(t: Tables) -> DataFrame:
    days = t.buckets().where("tile = 1").select("az_b", F.to_date("version").alias("day")).distinct()
    isl = days.withColumn("isl", F.date_sub("day", F.row_number().over(Window.partitionBy("az_b").orderBy("day"))))
    whole = Window.partitionBy("az_b", "isl")
    return isl.select("az_b", "day", (F.count("*").over(whole) - F.row_number().over(whole.orderBy("day")) + 1).alias("forward"))
