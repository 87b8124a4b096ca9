import datetime as dt
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenfold.functions import hours, rings, text, zones
from lumenfold.functions.numbers import half_up
from lumenfold.operators import checks, spatial, windows
from lumenfold.plans import catalog
from lumenfold.sources import readers, sinks
from lumenfold.streaming import streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    got = sorted(json.dumps([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    rel = duck.sql(catalog.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == sorted(json.dumps([plain(r[k]) for k in at]) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_half_up_goes_up(spark):
    df = rows(spark, [(-2.5,), (2.5,), (-0.4,), (None,)], "x double").select(half_up("x").alias("y"))
    assert [r.y for r in df.collect()] == [-2.0, 3.0, 0.0, None]


def test_change_of_clocks(spark):
    local = ["2026-10-25 02:30:00", "2026-03-29 02:30:00", "2026-07-01 12:00:00"]
    df = rows(spark, [(x,) for x in local], "t string").select(zones.to_utc(F.col("t").cast("timestamp"), "Europe/Zurich").cast("string").alias("u"))
    assert [r.u for r in df.collect()] == ["2026-10-25 01:30:00", "2026-03-29 01:30:00", "2026-07-01 10:00:00"]


@pytest.mark.parametrize(
    ("spec", "day", "minute", "want"),
    [
        ("24/7", 3, 0, (True, True, "open 24h")), ("Mo-Fr 08:00-22:00", 1, 480, (True, True, "open 08:00-22:00")), ("Mo-Fr 08:00-22:00", 1, 1320, (True, False, "closed, hours 08:00-22:00")),
        ("Mo-Fr 08:00-22:00", 6, 600, (True, False, "closed, opens +2 08:00")), ("Mo-Sa 08:00-12:00,14:00-18:00; Su off", 2, 750, (True, False, "closed, opens 14:00")),
        ("Fr-Mo 22:00-02:00", 0, 1400, (True, True, "open 22:00-24:00")), ("sunrise-sunset", 1, 1, (False, False, "")), ("", 1, 1, (False, False, "")), (None, 1, 1, (False, False, "")),
        ("off", 1, 1, (True, False, "closed")), ("Mo-Su 10:00-20:00; Tu off", 2, 700, (True, False, "closed, opens +1 10:00")), ("2024 Mo 10:00-12:00", 1, 650, (False, False, "")),
        ("Dec 10:00-12:00; Mo 09:00-10:00", 1, 550, (True, True, "open 09:00-10:00")), ("09:30-11:00", 5, 600, (True, True, "open 09:30-11:00")),
    ],
)
def test_opening_hours(spark, spec, day, minute, want):
    df = rows(spark, [(spec, day, minute)], "spec string, day int, minute int").select(hours.status(hours.parse_week("spec"), "day", "minute").alias("s"))
    assert tuple(df.first().s) == want


def test_sunny_windows_of_ties_and_open_tails(spark):
    t = lambda m: dt.datetime(2024, 5, 1, 10) + dt.timedelta(minutes=m)
    data = [("a", t(0), 1, True), ("a", t(15), 2, True), ("a", t(30), 3, False), ("a", t(45), 5, True), ("a", t(45), 4, False), ("b", t(0), 1, False)]
    got = windows.sunny_windows(rows(spark, data, "point string, ts timestamp, ord int, is_sunny boolean"), 15).orderBy("start").collect()
    assert [(r.point, r.start, r.end, r.minutes) for r in got] == [("a", t(0), t(30), 30), ("a", t(45), t(60), 15)]


def test_accepted_events_compare_with_the_last_accepted(spark):
    t = lambda s: dt.datetime(2024, 5, 1, 10, 0, s)
    df = rows(spark, [("a", t(s)) for s in (0, 3, 5, 7, 10, 14)], "k string, ts timestamp")
    assert [r.ts for r in windows.accepted_events(df, ["k"], "ts", 5).orderBy("ts").collect()] == [t(0), t(5), t(10)]
    assert [r.ts for r in windows.accepted_events(df, ["k"], "ts", 5, keep=1).collect()] == [t(10)]


def test_cell_join_equals_the_full_one(spark):
    rng = random.Random(42)
    obstacles = []
    for k in range(180):
        x, y, w, d = rng.uniform(-400, 400), rng.uniform(-400, 400), rng.uniform(6, 30), rng.uniform(6, 30)
        obstacles.append((k, x - w / 2, y - d / 2, x + w / 2, y + d / 2, rng.uniform(8, 88), x, y, (w * w + d * d) ** 0.5 / 2))
    probes = [(k, rng.uniform(-300, 300), rng.uniform(-300, 300), 0.0, rng.uniform(0, 360), rng.uniform(-5, 60)) for k in range(80)]
    o = rows(spark, obstacles, "id int, min_x double, min_y double, max_x double, max_y double, max_z double, center_x double, center_y double, half_diagonal double")
    p = rows(spark, probes, "probe int, x double, y double, z double, azimuth double, altitude double")
    got = {r.probe: (r.blocker, r.distance) for r in spatial.nearest_blocker(p, o, 300.0).collect()}
    all_ = p.where("altitude > 0").withColumn("dx", F.sin(F.radians("azimuth"))).withColumn("dy", F.cos(F.radians("azimuth"))).join(o, how="cross")
    best = spatial.ray_hits(all_, 300.0).groupBy("probe").agg(F.min(F.struct("distance", "id")).alias("b")).collect()
    want = {r.probe: (r.b.id, round(r.b.distance, 3)) for r in best}
    assert {k: (b, round(d, 3)) for k, (b, d) in got.items() if b is not None} == want and len(got) == 80


def test_rings(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = rows(spark, [([{"x": x, "y": y} for x, y in square],)], "r array<struct<x:double,y:double>>")
    got = df.select(
        rings.area("r").alias("area"), rings.contains("r", F.lit(2.0), F.lit(2.0)).alias("i"), rings.contains("r", F.lit(5.0), F.lit(2.0)).alias("o"),
        rings.ray_to_ring("r", F.lit(-3.0), F.lit(2.0), F.lit(1.0), F.lit(0.0)).alias("hit"), rings.ray_to_ring("r", F.lit(-3.0), F.lit(2.0), F.lit(-1.0), F.lit(0.0)).alias("miss"),
    ).first()
    assert tuple(got) == (16.0, True, False, 3.0, None)


def test_versions_and_names(spark):
    df = rows(spark, [("places-v1.10.0",), ("v1.9.9",), ("none",)], "t string").withColumn("v", text.version("t"))
    assert df.orderBy(F.desc("v")).first().t == "places-v1.10.0"
    dates = rows(spark, [("2024-02-30",), ("2024-02-29",), ("24-1-1",)], "d string").select(text.valid_date("d").alias("d"))
    assert [r.d for r in dates.collect()] == [None, dt.date(2024, 2, 29), None]


def test_holes_are_filled(spark):
    ring = [(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    df = rows(spark, [*ring, (9, 9)], "i int, j int")
    assert {(r.i, r.j) for r in checks.filled(df).collect()} == {*ring, (1, 1), (9, 9)}
    assert {tuple(r.component) for r in checks.components(df).collect()} == {(0, 0), (9, 9)}


def test_sources_and_sinks(spark, tmp_path):
    place = lambda k, name: {"id": k, "name": name, "region": "r", "lat": 1.0, "lon": 2.0, "tags": {"a": "b"}}
    (tmp_path / "places").mkdir()
    for f, ps in (("a-places.json", [place("1", "x"), place("2", "y")]), ("b-places.json", [place("1", "z")]), ("all-places.json", [place("9", "n")])):
        (tmp_path / "places" / f).write_text(json.dumps({"generated_at": "now", "places": ps}, indent=1))
    got = {r.id: r.name for r in readers.places(spark, str(tmp_path / "places")).collect()}
    assert got == {"1": "z", "2": "y"}
    (tmp_path / "raw.json").write_text(json.dumps({"elements": [{"type": "node", "id": 5, "lat": 1.5, "lon": 2.5, "tags": {"amenity": "bar"}}, {"type": "way", "id": 6, "center": {"lat": 3.0, "lon": 4.0}}]}))
    assert [(r.id, r.lat, r.center and r.center.lat) for r in readers.elements(spark, str(tmp_path / "raw.json")).orderBy("id").collect()] == [(5, 1.5, None), (6, None, 3.0)]
    (tmp_path / "runs" / "x").mkdir(parents=True)
    for k, day in enumerate(("2024-01-01", "2024-01-02", "2024-01-03")):
        (tmp_path / "runs" / "x" / f"m{k}.json").write_text(json.dumps({"region": "r", "hash": "h" if k else "g", "day": day, "tile_ids": ["t"]}))
    runs = readers.manifests(spark, str(tmp_path / "runs"), first="2024-01-02")
    assert runs.count() == 2
    ranks = {r.hash: r["rank"] for r in readers.ranked_hashes(readers.manifests(spark, str(tmp_path / "runs")), "g").collect()}
    assert ranks == {"g": 1, "h": 2}
    assert sinks.purge_plan(runs, before="2024-01-03").count() == 1
    buckets = spark.range(200).selectExpr("'r' as region", "0.75 as res", "concat('t', id % 4) as tile_id", "cast(id % 50 as int) as az_b", "cast(id % 7 as int) as alt_b", "id")
    sinks.write_index(buckets, str(tmp_path / "index"))
    keys = rows(spark, [(3, 3), (10, 3)], "az_b int, alt_b int")
    assert {r.id for r in readers.index_buckets(spark, str(tmp_path / "index"), keys).collect()} == {k for k in range(200) if (k % 50, k % 7) in {(3, 3), (10, 3)}}
    assert readers.index_keys(spark, str(tmp_path / "index")).count() == buckets.select("tile_id", "az_b", "alt_b").distinct().count()
    assert readers.file_sizes(spark, str(tmp_path / "index"), "*.parquet").agg(F.sum("files")).first()[0] >= 1
    masks = rows(spark, [([b"ab", b"c"],), (None,)], "m array<binary>").select(sinks.unblob(sinks.mask_blob("m")).alias("b"))
    assert [r.b and bytes(r.b) for r in masks.collect()] == [b"abc", None]
    sinks.write_features(rows(spark, [("n", 1.0, 2.0)], "name string, lon double, lat double"), str(tmp_path / "geo"), ["name"])
    assert json.loads(spark.read.text(str(tmp_path / "geo")).first().value)["geometry"]["coordinates"] == [1.0, 2.0]
    box = rows(spark, [(5.9, 45.9, 6.1, 46.0)], "min_lon double, min_lat double, max_lon double, max_lat double")
    assert {(r.south, r.west) for r in readers.degree_cells(box).collect()} == {(45, 5), (45, 6)}
    assert "food_court" in readers.extract_query(1, 2, 3, 4, ("bar", "food_court"))


def test_streams(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    stream = streams.event_stream(spark, str(tmp_path / "in"), schema, 1)
    samples = stream.selectExpr("user_id as point", "ts", "event_type <> 'error' as is_sunny")
    streams.run_to(streams.sunny_minutes(samples, 15, "60 days"), "minutes", str(tmp_path / "c1"), "complete")
    got = spark.table("minutes").agg(F.sum("minutes")).first()[0]
    assert got == 15 * events.where("event_type <> 'error'").count()
    streams.run_to(streams.sunny_sessions(samples, late="60 days"), "sessions", str(tmp_path / "c2"), "complete")
    assert spark.table("sessions").agg(F.sum("samples")).first()[0] == events.where("event_type <> 'error'").count()
    held = spark.createDataFrame([(1,), (2,)], "user_id long")
    streams.run_to(streams.without_held(stream.select("user_id"), held, "user_id"), "others", str(tmp_path / "c3"))
    assert spark.table("others").count() == events.where("user_id not in (1, 2)").count()
    one = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.run_to(streams.accepted(one, "user_id", 3600), "ok", str(tmp_path / "c4"))
    want = windows.accepted_events(events.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", 3600)
    assert spark.table("ok").select("user_id", "ts").exceptAll(want).count() == 0 and spark.table("ok").count() == want.count()
    streams.accumulate(stream.select("user_id", F.lit(1).alias("n")), str(tmp_path / "acc"), str(tmp_path / "c5"), ["user_id"], "n")
    last = max(int(p.name[6:]) for p in (tmp_path / "acc").glob("batch=*"))
    assert spark.read.parquet(str(tmp_path / "acc" / f"batch={last}")).agg(F.sum("n")).first()[0] == events.count()
