import time
from collections import OrderedDict

import pytest

from lumenfold.streaming import results


def tiles(spark, folder):
    return spark.readStream.schema("tile string, points bigint, places bigint").option("maxFilesPerTrigger", 1).parquet(str(folder))


def put(spark, folder, rows):
    spark.createDataFrame(rows, "tile string, points long, places long").coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(0.05)  # files are taken in the order of their times


def log(spark, path):
    return [(r.seq, r.kind, r.tile, r.n, r.done, r.total) for r in results.read_log(spark, str(path)).orderBy("seq").collect()]


def test_log_goes_on_after_a_stop_and_repeats_a_batch(spark, tmp_path, monkeypatch):
    put(spark, tmp_path / "in", [("b", 5, 0), ("a", 7, 2)])
    put(spark, tmp_path / "in", [("c", 1, 1)])
    put(spark, tmp_path / "in", [("d", 2, 0)])
    whole, calls = results._numbered, []

    def failing(rows, base, path):
        whole(rows, base, path)
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost after the second batch was written")

    monkeypatch.setattr(results, "_numbered", failing)
    at = (str(tmp_path / "log"), str(tmp_path / "check"))
    with pytest.raises(Exception, match="lost after"):
        results.publish(tiles(spark, tmp_path / "in"), *at, 4)
    assert [r[1] for r in log(spark, at[0])] == ["start", "tile", "places", "tile", "progress", "tile", "places", "progress"]
    results.publish(tiles(spark, tmp_path / "in"), *at, 4)
    want = [(0, "start", None, None, 0, 4), (1, "tile", "a", 7, None, None), (2, "places", "a", 2, None, None), (3, "tile", "b", 5, None, None), (4, "progress", None, None, 2, 4),
            (5, "tile", "c", 1, None, None), (6, "places", "c", 1, None, None), (7, "progress", None, None, 3, 4), (8, "tile", "d", 2, None, None), (9, "progress", None, None, 4, 4), (10, "done", None, 15, 4, 4)]
    assert log(spark, at[0]) == want


def test_log_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for held, kind in ((0, "error"), (3, "done")):
        results.publish(tiles(spark, tmp_path / "in"), f"{tmp_path}/log{held}", f"{tmp_path}/check{held}", 3, held)
        assert log(spark, f"{tmp_path}/log{held}") == [(0, kind, None, 0, 0, 3)]


def test_points_come_in_small_batches_and_go_on(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(0, 250, 1, 1).selectExpr("id", "id * 2 AS x").write.option("parquet.block.size", 1024).parquet(folder)
    spark.range(250, 260, 1, 1).selectExpr("id", "id * 2 AS x").write.mode("append").parquet(folder)
    run = lambda: results.run_in_batches(results.partial_points(spark, folder, "id bigint, x bigint"), f"{tmp_path}/out", f"{tmp_path}/check")
    sizes = lambda: {r.batch: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("batch").count().collect()}
    run()
    assert max(sizes().values()) == results.PARTIAL and sum(sizes().values()) == 260 and len(sizes()) == 4
    run()  # nothing new
    assert sum(sizes().values()) == 260
    spark.range(260, 270, 1, 1).selectExpr("id", "id * 2 AS x").write.mode("append").parquet(str(tmp_path / "in" / "z"))
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(270))


def test_reader_gives_the_same_rows_again(spark, tmp_path):
    spark.range(0, 10, 1, 1).write.parquet(str(tmp_path / "in"))
    reader = results.PointReader({"path": str(tmp_path / "in"), "points": "4"})
    at, seen = reader.initialOffset(), []
    while True:
        rows, end = reader.read(at)
        rows = list(rows)
        assert rows == ([] if end == at else list(reader.readBetweenOffsets(at, end)))
        if end == at:
            break
        at, seen = end, seen + rows
    assert seen == [(k,) for k in range(10)]
    (tmp_path / "none").mkdir()
    assert list(results.PointReader({"path": str(tmp_path / "none")}).read({"file": 0, "row": 0})[0]) == []


def test_cache_equals_an_ordered_dictionary(spark, tmp_path):
    import random

    rng, rows = random.Random(6), []
    for k in range(900):
        rows.append((rng.randrange(3), f"t{rng.randrange(12)}", rng.random() < 0.7, 1000 + k // 2, k))
    for part in (rows[:300], rows[300:600], rows[600:]):
        df = spark.createDataFrame(part, "client long, tile string, put boolean, s long, ord long").selectExpr("client", "tile", "put", "timestamp_seconds(s) AS ts", "ord")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    want, caches = [], {}
    for client, tile, is_put, _, ord_ in rows:
        c = caches.setdefault(client, OrderedDict())
        if tile in c:
            c.move_to_end(tile)
        elif is_put:
            c[tile] = None
            if len(c) > 5:
                want.append((client, ord_, c.popitem(last=False)[0]))
    stream = spark.readStream.schema("client bigint, tile string, put boolean, ts timestamp, ord bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = results.evictions(stream, 5)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.client, r.ord, r.evicted) for r in got) == sorted(want) and {r.size for r in got} == {5}


def test_feed_of_changes_and_counts(spark, tmp_path):
    spark.createDataFrame([(1, 1, "running"), (1, 1, "running"), (1, 3, "completed"), (1, 4, "running"), (2, 7, "running")], "job long, revision long, status string").write.parquet(str(tmp_path / "in"))
    jobs = spark.readStream.schema("job bigint, revision bigint, status string").parquet(str(tmp_path / "in"))
    counts = results.Counts()
    spark.streams.addListener(counts)
    try:
        q = results.changes(jobs, 0.5).writeStream.format("memory").queryName("feed").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="500 milliseconds").start()
        end = time.time() + 60
        while time.time() < end and not spark.sql("SELECT * FROM feed WHERE kind = 'heartbeat'").head(1):
            time.sleep(0.3)
        q.stop()
        time.sleep(1)
    finally:
        spark.streams.removeListener(counts)
    rows = [(r.job, r.kind, r.revision, r.status) for r in spark.sql("SELECT * FROM feed").collect()]
    assert sorted(r for r in rows if r[1] != "heartbeat") == [(1, "done", 3, "completed"), (1, "job", 1, "running"), (1, "job", 3, "completed"), (2, "job", 7, "running")]
    assert {r for r in rows if r[1] == "heartbeat"} == {(2, "heartbeat", 7, None)}
    assert counts.rows["feed"] == 5


def test_many_small_batches_come_together(spark, tmp_path):
    """batches of few points need no micro-batch each; every row tells its batch, also when it is read again."""
    spark.range(0, 100, 1, 1).write.parquet(str(tmp_path / "in"))
    stream = results.partial_points(spark, str(tmp_path / "in"), "id bigint, part int", 4, 10)
    results.run_in_batches(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.id, r.part) for r in got) == [(k, k // 4) for k in range(100)] and {r.batch for r in got} == {0, 1, 2}
    reader = results.PointReader({"path": str(tmp_path / "in"), "points": "4", "batches": "10"})
    first, end = reader.read(reader.initialOffset())
    assert end == {"file": 0, "row": 40, "batch": 10} and list(first) == list(reader.readBetweenOffsets(reader.initialOffset(), end))


def test_changes_ask_for_timers_of_known_jobs_alone():
    """a job's first rows read its state once and list no timers; they come as rows, not as a frame for each job."""
    from pyspark.sql import Row

    asked = []

    class Handle:
        def __getattr__(self, name):
            return lambda *_: asked.append(name) or self

        def get(self):
            asked.append("get")

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 0

    feed = results.Changes(1.0, ("F",))
    feed.init(Handle())
    asked.clear()
    out = list(feed.handleInputRows((7,), iter([Row(job=7, revision=2, status="F"), Row(job=7, revision=1, status="O")]), Clock()))
    assert [tuple(r) for r in out] == [(7, "job", 1, "O"), (7, "job", 2, "F"), (7, "done", 2, "F")] and asked == ["get", "update"]
