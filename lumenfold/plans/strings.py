"""Scalar functions: strings, dates, colours, levels and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import clamp, half_up
from ..operators import logs
from ..sources.tables import Tables
from .registry import query


@query("str01_folded", "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def _(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", text.folded("text").alias("folded"))


@query("str04_clock", "SELECT event_id, strftime(ts, '%H:%M') AS clock FROM events")
def _(t: Tables) -> DataFrame:
    return t.events().select("event_id", text.clock(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("clock"))


@query("str05_minutes", "SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minutes FROM events")
def _(t: Tables) -> DataFrame:
    return t.events().select("event_id", text.minutes(F.date_format("ts", "HH:mm")).alias("minutes"))


@query("str06_raster_names", "SELECT p_partkey AS id, CAST(2000 + p_size AS INTEGER) AS year, CAST(2000 + p_partkey % 900 AS INTEGER) AS east_km, 0.5e0 AS resolution FROM part")
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("surface_"), (2000 + F.col("p_size")).cast("string"), F.lit("_"), (2000 + k % 900).cast("string"), F.lit("-1152_0.5_2056.tif"))
    return t.read("part").select(k.alias("id"), text.raster_name(name).alias("r")).select("id", "r.year", "r.east_km", "r.resolution")


@query("str07_raster_kinds", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'composed' ELSE 'other' END AS kind FROM part")
def _(t: Tables) -> DataFrame:
    names = F.array(F.lit("canopy-RAW.tif"), F.lit("canopy_composed.tif"), F.lit("canopy.tif"))
    return t.read("part").select(F.col("p_partkey").alias("id"), text.raster_kind(F.element_at(names, (F.col("p_size") % 3 + 1).cast("int"))).alias("kind"))


@query("str08_latest_version", "SELECT p_brand AS brand, max((p_size % 4, p_size % 11, p_partkey % 17))[1] || '.' || max((p_size % 4, p_size % 11, p_partkey % 17))[2] || '.' || max((p_size % 4, p_size % 11, p_partkey % 17))[3] AS latest FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    tag = F.concat(F.lit("places-v"), F.concat_ws(".", F.col("p_size") % 4, F.col("p_size") % 11, F.col("p_partkey") % 17))
    top = t.read("part").select(F.col("p_brand").alias("brand"), tag.alias("tag")).groupBy("brand").agg(F.max(text.version("tag")).alias("v"))
    return top.select("brand", F.concat_ws(".", "v.major", "v.minor", "v.patch").alias("latest"))


@query("str11_locality", "SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 5 = 0 THEN 'suburb' END, n_name) AS locality FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(t: Tables) -> DataFrame:
    c = t.read("customer").join(F.broadcast(t.read("nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    k = F.col("c_custkey")
    return c.select(k.alias("id"), F.coalesce(F.when(k % 3 == 0, F.col("c_mktsegment")), F.when(k % 5 == 0, F.lit("suburb")), F.col("n_name")).alias("locality"))


@query("str12_warning_kinds", "SELECT event_type, CASE WHEN starts_with(event_type, 'err') THEN 'failure' WHEN event_type IN ('click', 'view') THEN 'notice' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(F.startswith(e, F.lit("err")), "failure").when(e.isin("click", "view"), "notice").otherwise("other")
    return t.events().groupBy("event_type", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("str13_partition_key", "SELECT run, region || '/' || priority || '/' || CAST(day AS VARCHAR) AS path FROM runs", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().select("run", F.concat_ws("/", "region", "priority", F.col("day").cast("string")).alias("path"))


@query("dt04_valid_dates", "SELECT event_id, TRY_CAST('2024-' || lpad(CAST(event_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(event_id % 33 AS VARCHAR), 2, '0') AS DATE) AS day FROM events")
def _(t: Tables) -> DataFrame:
    k = F.col("event_id")
    s = F.concat_ws("-", F.lit("2024"), text.two_digits(k % 14), text.two_digits(k % 33))
    return t.events().select("event_id", text.valid_date(s).alias("day"))


@query("mth10_exposure_colour", "SELECT event_id, CAST(floor(30 + (255 - 30) * greatest(0, least(1, value / 10)) + 0.5) AS BIGINT) AS red, CAST(floor(60 + (200 - 60) * greatest(0, least(1, value / 10)) + 0.5) AS BIGINT) AS green FROM events")
def _(t: Tables) -> DataFrame:
    x = clamp(F.col("value") / 10, 0.0, 1.0)
    mixed = lambda a, b: half_up(a + (b - a) * x).cast("bigint")
    return t.events().select("event_id", mixed(30, 255).alias("red"), mixed(60, 200).alias("green"))


@query("mth11_detail_level", "SELECT event_id, CASE WHEN value < 2 THEN 'coarse' WHEN value < 6 THEN 'medium' ELSE 'fine' END AS level, CAST(pow(2, floor(value / 2)) AS BIGINT) AS pixels FROM events WHERE value < 20")
def _(t: Tables) -> DataFrame:
    v = F.col("value")
    level = F.when(v < 2, "coarse").when(v < 6, "medium").otherwise("fine")
    return t.events().where("value < 20").select("event_id", level.alias("level"), F.pow(F.lit(2.0), F.floor(v / 2)).cast("bigint").alias("pixels"))


@query("mth12_corner_matrix", "SELECT id, (max_x - min_x) / 256 AS a, (max_y - min_y) / 256 AS d, min_x AS e, max_y AS f FROM obstacles", "obstacles")
def _(t: Tables) -> DataFrame:
    return t.obstacles().select("id", ((F.col("max_x") - F.col("min_x")) / 256).alias("a"), ((F.col("max_y") - F.col("min_y")) / 256).alias("d"), F.col("min_x").alias("e"), F.col("max_y").alias("f"))


@query("mth13_time_left", "SELECT run, CASE WHEN done > 0 THEN CAST(floor(elapsed * (total - done) / done + 0.5) AS BIGINT) END AS eta FROM (SELECT run, run % 40 AS done, 40 AS total, run % 600 AS elapsed FROM runs)", "runs")
def _(t: Tables) -> DataFrame:
    done, elapsed = F.col("run") % 40, F.col("run") % 600
    return t.runs().select("run", F.when(done > 0, half_up(elapsed * (40 - done) / done).cast("bigint")).alias("eta"))


@query("src23_log_phases", "SELECT event_id AS line_no, CAST(floor(value * 100) AS BIGINT) AS ms FROM events WHERE event_type = 'click'")
def _(t: Tables) -> DataFrame:
    line = F.concat(F.lit("[tile] phase="), F.col("event_type"), F.lit(" took "), F.floor(F.col("value") * 100).cast("string"), F.lit("ms"))
    return logs.phases(t.events().select(F.col("event_id").alias("line_no"), line.alias("line"))).where("phase = 'click'").select("line_no", "ms")


_LOG = "l AS (SELECT user_id AS log, ts, event_id AS line_no, CASE event_type WHEN 'click' THEN 'ipc' WHEN 'view' THEN 'tile' WHEN 'purchase' THEN 'merge' WHEN 'signup' THEN 'write' END AS kind FROM events)"
_GROUPS = "g AS (SELECT *, count(*) FILTER (WHERE kind = 'tile') OVER (PARTITION BY log ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_, count(*) FILTER (WHERE kind = 'tile') OVER (PARTITION BY log ORDER BY line_no) AS upto FROM l WHERE kind IS NOT NULL)"


@query("join30_log_correlation", f"""WITH {_LOG}, {_GROUPS}, a AS (SELECT log, before_ AS k, max(line_no) FILTER (WHERE kind = 'tile') AS tile_line, max(line_no) FILTER (WHERE kind = 'ipc') AS ipc_line FROM g GROUP BY 1, 2 HAVING count(*) FILTER (WHERE kind = 'tile') > 0),
  b AS (SELECT log, upto - 1 AS k, min(line_no) FILTER (WHERE kind = 'merge') AS merge_line, min(line_no) FILTER (WHERE kind = 'write') AS write_line FROM g GROUP BY 1, 2)
  SELECT log, tile_line, ipc_line, merge_line, write_line FROM a LEFT JOIN b USING (log, k)""")
def _(t: Tables) -> DataFrame:
    kinds = {"click": "ipc", "view": "tile", "purchase": "merge", "signup": "write"}
    kind = F.lit(None).cast("string")
    for event, k in kinds.items():
        kind = F.when(F.col("event_type") == event, k).otherwise(kind)
    lines = t.events().select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), kind.alias("kind")).where("kind is not null")
    return logs.tiles_with_calls(lines)
