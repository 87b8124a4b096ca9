"""Diagnostics: comparisons of runs, quality checks, histograms and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators import checks, contours, windows
from ..sources.tables import Tables
from .registry import query


@query("join21_compare_runs", "SELECT a.az_b, count(*) AS n, CAST(sum(CASE WHEN (a.v > 25) <> (b.v > 25) THEN 1 ELSE 0 END) AS BIGINT) AS differing FROM (SELECT az_b, alt_b, max(value) AS v FROM buckets WHERE tile = 1 GROUP BY 1, 2) a JOIN (SELECT az_b, alt_b, max(value) AS v FROM buckets WHERE tile = 2 GROUP BY 1, 2) b USING (az_b, alt_b) GROUP BY a.az_b", "buckets")
def _(t: Tables) -> DataFrame:
    run = lambda k, v: t.buckets().where(f"tile = {k}").groupBy("az_b", "alt_b").agg((F.max("value") > 25).alias(v))
    j = run(1, "a").join(run(2, "b"), ["az_b", "alt_b"])
    return j.groupBy("az_b").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("differing"))


@query("join29_divergent_points", "SELECT az_b, alt_b, CASE WHEN a.v THEN 'left only' ELSE 'right only' END AS direction FROM (SELECT az_b, alt_b, max(value) > 25 AS v FROM buckets WHERE tile = 1 GROUP BY 1, 2) a JOIN (SELECT az_b, alt_b, max(value) > 25 AS v FROM buckets WHERE tile = 2 GROUP BY 1, 2) b USING (az_b, alt_b) WHERE a.v <> b.v ORDER BY az_b, alt_b LIMIT 200", "buckets")
def _(t: Tables) -> DataFrame:
    run = lambda k, v: t.buckets().where(f"tile = {k}").groupBy("az_b", "alt_b").agg((F.max("value") > 25).alias(v))
    j = run(1, "a").join(run(2, "b"), ["az_b", "alt_b"]).where("a <> b")
    return j.select("az_b", "alt_b", F.when(F.col("a"), "left only").otherwise("right only").alias("direction")).orderBy("az_b", "alt_b").limit(200)


@query("set07_unmatched", """WITH a AS (SELECT DISTINCT az_b, alt_b FROM buckets WHERE tile = 1), b AS (SELECT DISTINCT az_b, alt_b FROM buckets WHERE tile = 2)
  SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_b, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both""", "buckets")
def _(t: Tables) -> DataFrame:
    b = t.buckets().withColumn("bucket", F.struct("az_b", "alt_b"))
    return checks.unmatched(b.where("tile = 1"), b.where("tile = 2"), "bucket")


@query("agg14_distinct_warnings", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS warnings FROM events WHERE value < 0.5 GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    return t.events().where("value < 0.5").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("warnings"))


@query("agg15_run_summary", "SELECT count(*) AS runs, count(*) FILTER (WHERE region = 'F') AS complete, floor(sum(size) * 100 + 0.5) / 100 AS size FROM runs", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().agg(F.count("*").alias("runs"), F.count_if(F.col("region") == "F").alias("complete"), half_up(F.sum("size"), 2).alias("size"))


@query("agg18_obstacle_dedup", "SELECT k, max(max_z) AS max_z, arg_max(id, (max_z, -id)) AS id, count(*) AS n FROM (SELECT *, floor(min_x / 60) || ':' || floor(min_y / 60) AS k FROM obstacles) GROUP BY k", "obstacles")
def _(t: Tables) -> DataFrame:
    key = F.concat_ws(":", *(F.floor(F.col(c) / 60).cast("double").cast("string") for c in ("min_x", "min_y")))
    return t.obstacles().groupBy(key.alias("k")).agg(F.max("max_z").alias("max_z"), F.max_by("id", F.struct("max_z", -F.col("id"))).alias("id"), F.count("*").alias("n"))


@query("agg19_latest_version", "SELECT tile, arg_max(ord, (version, ord, line)) AS ord FROM buckets GROUP BY tile", "buckets")
def _(t: Tables) -> DataFrame:
    return t.buckets().groupBy("tile").agg(F.max_by("ord", F.struct("version", "ord", "line")).alias("ord"))


@query("agg20_terrain_pick", "SELECT tile, ord, line FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY year(version) DESC, value, ord, line) AS r FROM buckets) WHERE r = 1", "buckets")
def _(t: Tables) -> DataFrame:
    return windows.first_by(t.buckets(), ["tile"], [F.desc(F.year("version")), F.col("value"), F.col("ord"), F.col("line")]).select("tile", "ord", "line")


@query("agg21_kind_priority", "SELECT region, arg_min(run, (priority, run)) AS run FROM runs GROUP BY region", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().groupBy("region").agg(F.min_by("run", F.struct("priority", "run")).alias("run"))


_NEAREST = "list_sort(list({v}))[least(count(*), CAST(floor({q} * count(*)) AS BIGINT) + 1)]"
_RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("agg27_nearest_rank", f"SELECT region, floor(avg(size) * 1e4 + 0.5) / 1e4 AS mean, {_NEAREST.format(v='size', q='0.5e0')} AS p50, {_NEAREST.format(v='size', q='0.95e0')} AS p95, {_NEAREST.format(v='size', q='0.99e0')} AS p99, max(size) AS top FROM runs GROUP BY region", "runs")
def _(t: Tables) -> DataFrame:
    rest = t.runs().groupBy("region").agg(half_up(F.avg("size"), 4).alias("mean"), F.max("size").alias("top"))
    return rest.join(windows.nearest_ranks(t.runs(), ["region"], "size", _RANKS), "region")


@query("agg29_sunny_histogram", "WITH p AS (SELECT point, avg(CASE WHEN is_sunny THEN 100e0 ELSE 0e0 END) AS pct FROM samples GROUP BY point) SELECT CAST(floor(pct / 5) * 5 AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (WHERE pct > 85) AS suspects FROM p GROUP BY 1", "samples")
def _(t: Tables) -> DataFrame:
    p = t.samples().groupBy("point").agg(F.avg(F.when(F.col("is_sunny"), 100.0).otherwise(0.0)).alias("pct"))
    return p.groupBy((F.floor(F.col("pct") / 5) * 5).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("pct") > 85).alias("suspects"))


@query("agg30_bucket_counts", "WITH c AS (SELECT tile, count(DISTINCT (az_b, alt_b)) AS n FROM buckets GROUP BY tile) SELECT n // 100 AS hundreds, count(*) AS tiles, count(*) FILTER (WHERE n < 1900) AS partial FROM c GROUP BY 1", "buckets")
def _(t: Tables) -> DataFrame:
    c = t.buckets().select("tile", "az_b", "alt_b").distinct().groupBy("tile").agg(F.count("*").alias("n"))
    return c.groupBy(F.floor(F.col("n") / 100).alias("hundreds")).agg(F.count("*").alias("tiles"), F.count_if(F.col("n") < 1900).alias("partial"))


@query("agg32_mismatch_pivot", "SELECT region, count(*) FILTER (WHERE priority < '3' AND size < 100000) AS sun_shade, count(*) FILTER (WHERE priority >= '3' AND size >= 100000) AS shade_sun, count(*) AS n FROM runs GROUP BY region", "runs")
def _(t: Tables) -> DataFrame:
    a, b = F.col("priority") < "3", F.col("size") >= 100000
    return t.runs().groupBy("region").agg(F.count_if(a & ~b).alias("sun_shade"), F.count_if(~a & b).alias("shade_sun"), F.count("*").alias("n"))


@query("agg33_reasons", "SELECT priority AS reason, count(*) AS n FROM runs WHERE size < 50000 GROUP BY 1", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().where("size < 50000").groupBy(F.col("priority").alias("reason")).agg(F.count("*").alias("n"))


@query("agg35_strategies", "WITH p AS (SELECT owner, sum(CASE WHEN priority < '3' THEN 1 ELSE 0 END) AS m, abs(sum(CASE WHEN region = 'F' THEN 1 ELSE -1 END)) AS d FROM runs GROUP BY owner) SELECT CAST(sum(m) AS BIGINT) AS mismatches, count(*) FILTER (WHERE m > 0) AS points, floor(avg(d) * 1e9 + 0.5) / 1e9 AS mean_delta, CAST(max(d) AS BIGINT) AS max_delta FROM p", "runs")
def _(t: Tables) -> DataFrame:
    p = t.runs().groupBy("owner").agg(F.count_if(F.col("priority") < "3").alias("m"), F.abs(F.sum(F.when(F.col("region") == "F", 1).otherwise(-1))).alias("d"))
    return p.agg(F.sum("m").alias("mismatches"), F.count_if(F.col("m") > 0).alias("points"), half_up(F.avg("d"), 9).alias("mean_delta"), F.max("d").alias("max_delta"))


@query("agg39_content_hash", "WITH d AS (SELECT region, day, sha256(string_agg(CAST(run AS VARCHAR), ',' ORDER BY run)) AS h FROM runs GROUP BY region, day) SELECT region, left(sha256(string_agg(h, ',' ORDER BY day)), 16) AS hash FROM d GROUP BY region", "runs")
def _(t: Tables) -> DataFrame:
    """A hash of the days' hashes, so that no region's runs are gathered in one place."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("run")), lambda r: r.cast("string")), ",")
    days = t.runs().groupBy("region", "day").agg(F.sha2(ids, 256).alias("h"))
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "h"))), lambda d: d["h"]), ",")
    return days.groupBy("region").agg(F.substring(F.sha2(all_, 256), 1, 16).alias("hash"))


@query("agg40_histogram_quantile", "WITH b AS (SELECT CAST(least(5000, floor(value * 100)) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS run FROM b) SELECT min(bin) AS p95 FROM c WHERE run >= 0.95e0 * (SELECT count(*) FROM events)")
def _(t: Tables) -> DataFrame:
    b = t.events().groupBy(F.least(F.lit(5000), F.floor(F.col("value") * 100)).alias("bin")).agg(F.count("*").alias("n"))
    running = b.withColumn("run", F.sum("n").over(Window.orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return running.where("run >= 0.95D * total").agg(F.min("bin").alias("p95"))


@query("agg42_histogram_and_caps", "SELECT cap, count(*) FILTER (WHERE size <= cap * 50000) AS kept, count(*) FILTER (WHERE size > cap * 50000) AS dropped FROM runs, (VALUES (1), (3), (5)) v(cap) GROUP BY cap", "runs")
def _(t: Tables) -> DataFrame:
    each = t.runs().select("size", F.explode(F.array(*map(F.lit, (1, 3, 5)))).alias("cap"))
    return each.groupBy("cap").agg(F.count_if(F.col("size") <= F.col("cap") * 50000).alias("kept"), F.count_if(F.col("size") > F.col("cap") * 50000).alias("dropped"))


@query("agg43_day_transitions", "WITH d AS (SELECT point, CAST(ts AS DATE) AS day, avg(CASE WHEN is_sunny THEN 1e0 ELSE 0e0 END) > 0.8 AS s FROM samples GROUP BY 1, 2), l AS (SELECT *, lag(s) OVER (PARTITION BY point ORDER BY day) AS p FROM d) SELECT day, count(*) FILTER (WHERE p <> s) AS changed, count(*) FILTER (WHERE s AND NOT p) AS became_sunny, count(*) FILTER (WHERE p AND NOT s) AS became_shaded FROM l GROUP BY day", "samples")
def _(t: Tables) -> DataFrame:
    d = t.samples().groupBy("point", F.to_date("ts").alias("day")).agg((F.avg(F.col("is_sunny").cast("double")) > 0.8).alias("s"))
    was = d.withColumn("p", F.lag("s").over(Window.partitionBy("point").orderBy("day")))
    return was.groupBy("day").agg(F.count_if(F.col("p") != F.col("s")).alias("changed"), F.count_if(F.col("s") & ~F.col("p")).alias("became_sunny"), F.count_if(F.col("p") & ~F.col("s")).alias("became_shaded"))


_PHASES = "SELECT {} AS phase, l_returnflag AS state, {} AS v FROM lineitem"
_PHASE_SQL = " UNION ALL ".join(_PHASES.format(f"'{c}'", f"l_{c}") for c in ("tax", "discount", "quantity", "extendedprice"))


@query("agg44_phase_table", f"WITH l AS ({_PHASE_SQL}), a AS (SELECT phase, state, count(*) AS n, avg(v) AS mean_, {', '.join(f'{_NEAREST.format(v=chr(118), q=repr(q) + chr(101) + chr(48))} AS {p}' for p, q in _RANKS.items())}, max(v) AS top FROM l GROUP BY phase, state) SELECT phase, state, n, floor(mean_ * 1e6 + 0.5) / 1e6 AS mean, p50, p95, p99, top, floor(100 * mean_ / sum(mean_) OVER (PARTITION BY state) * 1e6 + 0.5) / 1e6 AS pct FROM a")
def _(t: Tables) -> DataFrame:
    """Phases by state: mean, ranks, maximum and the share of the state's mean total."""
    wide = t.read("lineitem").select(F.col("l_returnflag").alias("state"), *(F.col(f"l_{c}").alias(c) for c in ("tax", "discount", "quantity", "extendedprice")))
    long = wide.unpivot(["state"], ["tax", "discount", "quantity", "extendedprice"], "phase", "v")
    a = long.groupBy("phase", "state").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.max("v").alias("top"))
    a = a.withColumn("total", F.sum("m").over(Window.partitionBy("state"))).join(windows.nearest_ranks(long, ["phase", "state"], "v", _RANKS), ["phase", "state"])
    return a.select("phase", "state", "n", half_up("m", 6).alias("mean"), *_RANKS, "top", half_up(100 * F.col("m") / F.col("total"), 6).alias("pct"))


@query("agg41_in_flight", """WITH d AS (SELECT user_id, list({'now': CASE event_type WHEN 'error' THEN -1 ELSE 1 END, 'top': 0} ORDER BY ts, event_id) AS e FROM events GROUP BY user_id),
  f AS (SELECT user_id, list_reduce(list_prepend({'now': 0, 'top': 0}, e), lambda a, x: {'now': greatest(0, a.now + x.now), 'top': greatest(a.top, greatest(0, a.now + x.now))}) AS s FROM d) SELECT user_id, CAST(s.now AS BIGINT) AS now, CAST(s.top AS BIGINT) AS top FROM f""")
def _(t: Tables) -> DataFrame:
    """Requests in flight by route at the end and at most; a decrement never goes below 0."""
    return windows.floored_sums(t.events().withColumn("d", F.when(F.col("event_type") == "error", -1).otherwise(1)), ["user_id"], ["ts", "event_id"], "d").groupBy("user_id").agg(
        F.max_by("now", F.struct("ts", "event_id")).alias("now"), F.greatest(F.lit(0), F.max("now")).alias("top")
    )


@query("win07_accepted_warnings", """WITH RECURSIVE e AS (SELECT DISTINCT user_id, CAST(ts AS TIMESTAMP) AS ts FROM events), a AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION ALL SELECT a.user_id, min(e.ts) AS ts FROM a JOIN e ON e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 1 HOUR GROUP BY a.user_id) SELECT user_id, ts FROM a""")
def _(t: Tables) -> DataFrame:
    """Warnings at least an hour after the last accepted one of their user."""
    return windows.accepted_events(t.events(), ["user_id"], "ts", 3600)


@query("win13_counter_deltas", "WITH l AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, floor(avg(CASE WHEN p <> 0 THEN (value - p) / p END) * 1e6 + 0.5) / 1e6 AS mean FROM l GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    p = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    d = t.events().withColumn("p", p)
    return d.groupBy("user_id").agg(half_up(F.avg(F.when(F.col("p") != 0, (F.col("value") - F.col("p")) / F.col("p"))), 6).alias("mean"))


@query("win13_busy_shares", """WITH g AS (SELECT CAST(ts AS DATE) AS day, user_id % 8 AS core, event_type AS kind, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY ALL),
  w AS (SELECT day, core, coalesce(sum(v) FILTER (kind <> 'error'), 0) AS busy, coalesce(sum(v) FILTER (kind = 'error'), 0) AS rest FROM g GROUP BY ALL), f AS (SELECT core, min(day) AS a FROM w GROUP BY core),
  s AS (SELECT day, floor(busy * 1e0 / (busy + rest) * 100 * 10 + 0.5) / 10 AS share FROM w JOIN f USING (core) WHERE day > a AND busy + rest > 0 UNION ALL SELECT day, 0 FROM w JOIN f USING (core) WHERE day > a AND busy + rest = 0)
  SELECT day AS "at", count(*) AS cores, floor((2 * sum(CAST(round(share * 10) AS BIGINT)) + count(*)) / (2 * count(*))) / 10 AS average, max(share) AS highest FROM s GROUP BY day""")
def _(t: Tables) -> DataFrame:
    """Daily snapshots of eight cores, whose counters grow with the values of their events: how busy they were from day to day."""
    kinds = {"view": "user", "signup": "nice", "click": "sys", "purchase": "irq", "error": "idle"}
    e = t.events().select(F.to_date("ts").alias("at"), (F.col("user_id") % 8).alias("core"), "event_type", F.floor(F.col("value") * 100).alias("v"))
    day = e.groupBy("at", "core").agg(*(F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("v"))), F.lit(0)).alias(c) for k, c in kinds.items()))
    so_far = Window.partitionBy("core").orderBy("at")
    return checks.busy_shares(day.select("at", "core", *(F.sum(c).over(so_far).alias(c) for c in kinds.values())))


@query("win15_first_transitions", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS m, event_type = 'error' AS b, lag(event_type = 'error') OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS p FROM events) SELECT user_id, day, min(m) FILTER (WHERE b AND NOT p AND m >= 720) AS first_blocked, min(m) FILTER (WHERE p AND NOT b AND m <= 720) AS first_release FROM d GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    day, b = F.to_date("ts"), F.col("event_type") == "error"
    d = t.events().select("user_id", "ts", "event_id", day.alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("m"), b.alias("b"))
    d = d.withColumn("p", F.lag("b").over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")))
    return d.groupBy("user_id", "day").agg(
        F.min(F.when(F.col("b") & ~F.col("p") & (F.col("m") >= 720), F.col("m"))).cast("bigint").alias("first_blocked"),
        F.min(F.when(F.col("p") & ~F.col("b") & (F.col("m") <= 720), F.col("m"))).cast("bigint").alias("first_release"),
    )


@query("win06_hysteresis", "SELECT event_id, coalesce(last_value(CASE WHEN value > 8 THEN 'coarse' WHEN value < 2 THEN 'fine' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'fine') AS mode FROM events")
def _(t: Tables) -> DataFrame:
    """Render mode of each event: coarse above 8, fine below 2, else as before."""
    told = F.when(F.col("value") > 8, "coarse").when(F.col("value") < 2, "fine")
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events().select("event_id", F.coalesce(F.last(told, True).over(so_far), F.lit("fine")).alias("mode"))


_CELLS = "ce AS (SELECT p_partkey % 211 AS i, p_partkey // 211 AS j FROM part WHERE p_size % 2 = 0)"


def _cells(t: Tables) -> DataFrame:
    """A band of cells 211 wide, as long as the table, about half of which are taken."""
    k = F.col("p_partkey")
    return t.read("part").where("p_size % 2 = 0").select((k % 211).alias("i"), F.floor(k / 211).alias("j"))


@query("set06_outline_edges", f"WITH {_CELLS}, e AS (SELECT i AS x1, j AS y1, i + 1 AS x2, j AS y2 FROM ce UNION ALL SELECT i, j + 1, i + 1, j + 1 FROM ce UNION ALL SELECT i, j, i, j + 1 FROM ce UNION ALL SELECT i + 1, j, i + 1, j + 1 FROM ce) SELECT x1, y1, x2, y2 FROM e GROUP BY ALL HAVING count(*) = 1")
def _(t: Tables) -> DataFrame:
    return checks.outline_edges(_cells(t)).select("x1", "y1", "x2", "y2")


@query("set06_outline_rings", f"""WITH RECURSIVE {_CELLS}, r(i, j, ci, cj) AS (SELECT i, j, i, j FROM ce UNION SELECT ce.i, ce.j, r.ci, r.cj FROM r JOIN ce ON abs(ce.i - r.i) + abs(ce.j - r.j) = 1), k AS (SELECT i, j, min((ci, cj))[1] AS ci, min((ci, cj))[2] AS cj FROM r GROUP BY i, j),
  n AS (SELECT a.i, a.j, count(b.i) AS n FROM ce a LEFT JOIN ce b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY a.i, a.j) SELECT CAST(ci AS BIGINT) AS ci, CAST(cj AS BIGINT) AS cj, CAST(sum(4 - n) AS BIGINT) AS edges FROM k JOIN n USING (i, j) GROUP BY ci, cj""")
def _(t: Tables) -> DataFrame:
    """Every component's outline walked into closed rings; the rings' edges add up to the component's free sides."""
    comp = checks.components(_cells(t)).select("i", "j", F.concat_ws(" ", "component.i", "component.j").alias("component"))
    rings_ = contours.outline_rings(checks.outline_edges(_cells(t)), comp)
    name = lambda k: F.split("component", " ")[k].cast("bigint")
    return rings_.groupBy("component").agg(F.sum(F.when(F.col("closed"), F.size("points"))).alias("edges")).select(name(0).alias("ci"), name(1).alias("cj"), "edges")


#: Directed sides with their tile on the left, what follows each (left before straight before right), and every ring's edges from each of its own.
_WALK = """e AS (SELECT layer, i AS x, j AS y, 0 AS d, i + 1 AS tx, j AS ty FROM tl a WHERE NOT EXISTS (FROM tl b WHERE b.layer = a.layer AND b.i = a.i AND b.j = a.j - 1)
    UNION ALL SELECT layer, i + 1, j, 1, i + 1, j + 1 FROM tl a WHERE NOT EXISTS (FROM tl b WHERE b.layer = a.layer AND b.i = a.i + 1 AND b.j = a.j)
    UNION ALL SELECT layer, i + 1, j + 1, 2, i, j + 1 FROM tl a WHERE NOT EXISTS (FROM tl b WHERE b.layer = a.layer AND b.i = a.i AND b.j = a.j + 1)
    UNION ALL SELECT layer, i, j + 1, 3, i, j FROM tl a WHERE NOT EXISTS (FROM tl b WHERE b.layer = a.layer AND b.i = a.i - 1 AND b.j = a.j)),
  nx AS (SELECT a.layer, (a.x, a.y, a.d) AS s, a.tx, a.ty, a.d AS d, arg_min((b.x, b.y, b.d), CASE (b.d - a.d + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS t FROM e a JOIN e b ON a.layer = b.layer AND a.tx = b.x AND a.ty = b.y GROUP BY ALL),
  wk(layer, s, t) AS (SELECT layer, s, t FROM nx UNION SELECT wk.layer, wk.s, nx.t FROM wk JOIN nx ON wk.layer = nx.layer AND wk.t = nx.s),
  rg AS (SELECT layer, s, min(t) AS ring FROM wk GROUP BY layer, s)"""


@query("set06_ring_corners", f"""WITH RECURSIVE {_CELLS}, tl AS (SELECT 0 AS layer, i, j FROM ce), {_WALK}
  SELECT CAST(ring[1] AS BIGINT) AS x, CAST(ring[2] AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS edges, CAST(count(*) FILTER (t[3] <> d) AS BIGINT) AS corners, CAST(sum(s[1] * ty - tx * s[2]) / 2 AS DOUBLE) AS area FROM nx JOIN rg USING (layer, s) GROUP BY layer, ring""")
def _(t: Tables) -> DataFrame:
    """Edges, corners and signed area of every outline, outer ones and holes; no ring is gathered."""
    p = contours.outline_points(checks.outline_edges(_cells(t)))
    d = F.col("d")
    ahead = lambda c, plus, minus: F.col(c) + F.when(d == plus, 1).when(d == minus, -1).otherwise(0)
    cross = F.col("x") * ahead("y", 1, 3) - ahead("x", 0, 2) * F.col("y")
    return p.groupBy("ring").agg(F.count("*").alias("edges"), F.count_if("corner").alias("corners"), (F.sum(cross) / 2).cast("double").alias("area")).select(
        F.col("ring.x").cast("bigint").alias("x"), F.col("ring.y").cast("bigint").alias("y"), "edges", "corners", "area"
    )


@query("arr10_unified_contours", f"""WITH RECURSIVE cu AS (SELECT p_partkey % 97 AS i, p_partkey // 97 AS j, p_size % 5 <> 0 AS outdoor, p_size % 2 = 0 AS sunny FROM part WHERE p_partkey % 13 <> 0),
  bd AS (SELECT min(i) AS li, max(i) AS hi, min(j) AS lj, max(j) AS hj FROM cu), gd AS (SELECT x.i, y.j FROM bd, LATERAL (SELECT unnest(range(li, hi + 1)) AS i) x, LATERAL (SELECT unnest(range(lj, hj + 1)) AS j) y),
  nb AS (SELECT g.i, g.j, arg_min(c.sunny, k) AS near FROM gd g, (VALUES (0, 0, -1), (1, 0, 1), (2, -1, 0), (3, 1, 0)) s(k, a, b) JOIN cu c ON c.outdoor AND c.i = g.i + a AND c.j = g.j + b GROUP BY g.i, g.j),
  fl AS (SELECT g.i, g.j, coalesce(c.outdoor, false) AS outdoor, CASE WHEN c.outdoor THEN c.sunny ELSE near END AS lit, c.i IS NOT NULL AS known FROM gd g LEFT JOIN cu c ON c.i = g.i AND c.j = g.j LEFT JOIN nb ON nb.i = g.i AND nb.j = g.j),
  tl AS (SELECT 'sunny' AS layer, i, j FROM fl WHERE lit UNION ALL SELECT 'shadow', i, j FROM fl WHERE NOT lit UNION ALL SELECT 'buildings', i, j FROM fl WHERE known AND NOT outdoor), {_WALK},
  md AS (SELECT layer, s, ring, s[1] + CASE s[3] WHEN 0 THEN 0.5e0 WHEN 2 THEN -0.5e0 ELSE 0 END AS x, s[2] + CASE s[3] WHEN 1 THEN 0.5e0 WHEN 3 THEN -0.5e0 ELSE 0 END AS y FROM rg)
  SELECT a.layer, CAST(a.ring[1] AS BIGINT) AS rx, CAST(a.ring[2] AS BIGINT) AS ry, count(*) AS points, sum(a.x * b.y - b.x * a.y) / 2 AS area FROM md a JOIN nx ON nx.layer = a.layer AND nx.s = a.s JOIN md b ON b.layer = a.layer AND b.s = nx.t GROUP BY a.layer, a.ring""")
def _(t: Tables) -> DataFrame:
    """Points and area of every line around sun, shade and buildings, over tiles with gaps."""
    k = F.col("p_partkey")
    cells = t.read("part").where("p_partkey % 13 <> 0").select((k % 97).alias("i"), F.floor(k / 97).alias("j"), (F.col("p_size") % 5 != 0).alias("outdoor"), (F.col("p_size") % 2 == 0).alias("sunny"))
    area = F.sum(F.col("bx") * F.col("y") - F.col("x") * F.col("by")) / 2
    return contours.unified_contours(cells).groupBy("layer", "ring").agg(F.count("*").alias("points"), area.alias("area")).select("layer", F.col("ring.x").cast("bigint").alias("rx"), F.col("ring.y").cast("bigint").alias("ry"), "points", "area")


@query("dq05_no_elevation", "SELECT p_brand AS tile, count(*) AS points FROM part WHERE p_size % 5 > 0 GROUP BY p_brand HAVING count(*) FILTER (WHERE p_size > 45) = 0")
def _(t: Tables) -> DataFrame:
    p = t.read("part").select(F.col("p_brand").alias("tile"), (F.col("p_size") % 5 > 0).alias("outdoor"), F.when(F.col("p_size") > 45, F.col("p_retailprice")).alias("z"))
    return checks.without_elevation(p, "tile", "outdoor", "z")


@query("set09_components", f"""WITH RECURSIVE {_CELLS}, r(i, j, ci, cj) AS (SELECT i, j, i, j FROM ce UNION SELECT ce.i, ce.j, r.ci, r.cj FROM r JOIN ce ON abs(ce.i - r.i) + abs(ce.j - r.j) = 1) SELECT i, j, min((ci, cj))[1] AS ci, min((ci, cj))[2] AS cj FROM r GROUP BY i, j""")
def _(t: Tables) -> DataFrame:
    return checks.components(_cells(t)).select("i", "j", F.col("component.i").alias("ci"), F.col("component.j").alias("cj"))


_STEPS = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(a, b)"
_PASSES = ", ".join(f"f{k} AS MATERIALIZED (SELECT i, j FROM f{k - 1} UNION SELECT i, j FROM (SELECT i + a AS i, j + b AS j FROM f{k - 1}, {_STEPS}) GROUP BY i, j HAVING count(*) >= 3)" for k in range(1, 21))


@query("set10_filled", f"WITH {_CELLS}, f0 AS (SELECT i, j FROM ce), {_PASSES} SELECT i, j FROM f20")
def _(t: Tables) -> DataFrame:
    return checks.filled(_cells(t))


@query("set11_priority_union", "SELECT owner, src, run FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY src, run) AS r FROM (SELECT owner, run, CASE region WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS src FROM runs)) WHERE r = 1", "runs")
def _(t: Tables) -> DataFrame:
    parts = [t.runs().where(c).select("owner", "run", F.lit(k).alias("src")) for k, c in enumerate(("region = 'P'", "region = 'O'", "region not in ('P', 'O')"))]
    return windows.first_by(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["owner"], [F.col("src"), F.col("run")]).select("owner", "src", "run")


@query("snk06_manifest_upsert", "WITH m AS (SELECT region, day, list_sort(list(DISTINCT owner) FILTER (WHERE size >= 50000)) AS ids, list_sort(list(DISTINCT owner) FILTER (WHERE size < 50000)) AS bad FROM runs GROUP BY region, day), n AS (SELECT region, day, coalesce(ids, []) AS ids, list_filter(coalesce(bad, []), lambda x: NOT list_contains(coalesce(ids, []), x)) AS failed FROM m) SELECT region, day, array_to_string(ids, ',') AS ids, array_to_string(failed, ',') AS failed, len(failed) = 0 AS complete FROM n", "runs")
def _(t: Tables) -> DataFrame:
    """One manifest for each region and day, united from its urgent and its other runs."""
    r, some = t.runs(), F.col("size") >= 50000
    side = lambda c: r.where(c).groupBy("region", "day").agg(F.collect_list(F.when(some, F.col("owner"))).alias("ids"), F.collect_list(F.when(~some, F.col("owner"))).alias("failed"))
    m = checks.merged_manifest(side("priority < '3'"), side("priority >= '3'"), ["region", "day"], "ids", "failed")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return m.select("region", "day", text("ids"), text("failed"), "complete")


@query("dq01_dense_outdoor_index", "SELECT tile, count(*) AS n, max(az_b) AS top, max(az_b) + 1 = count(*) AND count(DISTINCT az_b) = count(*) AS ok FROM (SELECT DISTINCT tile, az_b FROM buckets) GROUP BY tile", "buckets")
def _(t: Tables) -> DataFrame:
    return checks.dense_index(t.buckets().select("tile", "az_b").distinct(), "tile", "az_b").select("tile", "n", "top", "ok")


@query("dq02_health_labels", "SELECT CASE WHEN region = 'P' THEN 'missing' WHEN priority = '5-LOW' THEN 'warning' WHEN size < 20000 THEN 'none' ELSE 'healthy' END AS health, count(*) AS n FROM runs GROUP BY 1", "runs")
def _(t: Tables) -> DataFrame:
    label = F.when(F.col("region") == "P", "missing").when(F.col("priority") == "5-LOW", "warning").when(F.col("size") < 20000, "none").otherwise("healthy")
    return t.runs().groupBy(label.alias("health")).agg(F.count("*").alias("n"))


@query("dq03_index_invariants", "SELECT region, max(run) AS top, count(*) AS n, max(run) + 1 = count(*) AS ok FROM runs GROUP BY region", "runs")
def _(t: Tables) -> DataFrame:
    return t.runs().groupBy("region").agg(F.max("run").alias("top"), F.count("*").alias("n"), (F.max("run") + 1 == F.count("*")).alias("ok"))


@query("dq04_completeness", "SELECT source, floor(avg(CASE WHEN id % 4 > 0 THEN 1e0 ELSE 0e0 END) * 1e9 + 0.5) / 1e9 AS ratio FROM obstacles GROUP BY source HAVING avg(CASE WHEN id % 4 > 0 THEN 1e0 ELSE 0e0 END) < 0.76", "obstacles")
def _(t: Tables) -> DataFrame:
    g = t.obstacles().groupBy("source").agg(F.avg((F.col("id") % 4 > 0).cast("double")).alias("r"))
    return g.where("r < 0.76D").select("source", half_up("r", 9).alias("ratio"))


@query("dq06_grid_references", "SELECT l_partkey AS ref, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    known = t.read("part").where("p_size > 5").select(F.col("p_partkey").alias("ref"))
    return t.read("lineitem").select(F.col("l_partkey").alias("ref")).join(known, "ref", "left_anti").groupBy("ref").agg(F.count("*").alias("n"))


@query("dq07_drift", "SELECT tile, arg_max(ord, (version, ord, line)) AS ord, count(DISTINCT alt_b) AS width FROM buckets GROUP BY tile HAVING count(DISTINCT alt_b) > 6", "buckets")
def _(t: Tables) -> DataFrame:
    g = t.buckets().groupBy("tile").agg(F.max_by("ord", F.struct("version", "ord", "line")).alias("ord"), F.countDistinct("alt_b").alias("width"))
    return g.where("width > 6")


@query("dq08_partial_tiles", "SELECT tile, count(*) AS n FROM buckets WHERE value < 3 GROUP BY tile HAVING count(*) < 125", "buckets")
def _(t: Tables) -> DataFrame:
    return t.buckets().where("value < 3").groupBy("tile").agg(F.count("*").alias("n")).where("n < 125")


@query("dq09_repair_plan", "WITH d AS (SELECT DISTINCT tile FROM buckets WHERE alt_b = 7 AND value > 49), r AS (SELECT DISTINCT day FROM runs) SELECT tile, day FROM d, r", "buckets", "runs")
def _(t: Tables) -> DataFrame:
    drifted = t.buckets().where("alt_b = 7 and value > 49").select("tile").distinct()
    days = t.runs().select("day").distinct()
    return drifted.join(days, how="cross")


@query("dq14_empty_artifacts", "SELECT user_id FROM events GROUP BY user_id HAVING sum(CASE WHEN event_type = 'signup' AND value > 9.9 THEN 1 ELSE 0 END) = 0")
def _(t: Tables) -> DataFrame:
    return t.events().groupBy("user_id").agg(F.count_if((F.col("event_type") == "signup") & (F.col("value") > 9.9)).alias("n")).where("n = 0").select("user_id")


@query("dq15_unmatched_obstacles", "WITH m AS (SELECT source, min(center_x) AS mx FROM obstacles WHERE id % 50 = 0 GROUP BY source) SELECT o.source, count(*) AS n, count(*) FILTER (WHERE m.source IS NULL OR abs(center_x - mx) > 200) AS unmatched FROM obstacles o LEFT JOIN m ON o.source = m.source GROUP BY o.source", "obstacles")
def _(t: Tables) -> DataFrame:
    o = t.obstacles()
    m = o.where("id % 50 = 0").groupBy("source").agg(F.min("center_x").alias("mx"))
    return o.join(m, "source", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("mx").isNull() | (F.abs(F.col("center_x") - F.col("mx")) > 200)).alias("unmatched"))
