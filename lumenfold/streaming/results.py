"""Streams of results: a log of typed rows, points in small batches, a bounded cache and a feed of changes."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from ..sources.rasterfiles import pafs

#: The log's columns: tile and n (points or places) where the kind has them, done and total tiles with progress.
LOG = "batch bigint, seq bigint, kind string, tile string, n bigint, done bigint, total bigint"
#: Points of a partial batch; tiles that a client keeps. (Fixed values.)
PARTIAL, KEPT = 120, 1000


def _numbered(rows: DataFrame, base: int, path: str) -> None:
    """Write rows (ord, kind, tile, n, done, total) with seq counted on from base in the order of ord, however many they are."""
    spark = rows.sparkSession
    rows.repartitionByRange("ord").withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(f"{path}.dealt")
    dealt = spark.read.schema(f"{_dealt_schema(rows)}, part int").parquet(f"{path}.dealt")
    begins, at = [], base
    for r in sorted(dealt.groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda r: r.part):
        begins.append((r.part, at))
        at += r.n
    begin = spark.createDataFrame(begins, "part int, begin long")
    nth = F.row_number().over(Window.partitionBy("part").orderBy("ord")) - 1
    out = dealt.withColumn("nth", nth).join(F.broadcast(begin), "part")
    out.select((F.col("begin") + F.col("nth")).alias("seq"), "kind", "tile", "n", "done", "total").write.mode("overwrite").parquet(path)


def _dealt_schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def publish(tiles: DataFrame, path: str, checkpoint: str, total: int, held: int = 0) -> StreamingQuery:
    """Work off a stream of finished tiles (tile, points, places) into a log of typed rows below path, and stop.

    Each micro-batch adds a folder batch=N: in the first one a row "start", for every tile, by name, a row "tile" and, if it has
    any, "places", and at its end "progress". At last comes "done" with the tiles and points of all, or "error" where nothing
    came and the client holds nothing (``held`` tiles). seq counts all rows from 0 without a gap. A batch that runs again after a failure
    writes the same rows to the same folder.
    """
    spark = tiles.sparkSession

    def state(number: int) -> tuple[int, int]:
        """Rows and tiles of all batches before this one: what the last one's progress says."""
        if number == 0:
            return 0, 0
        last = read_log(spark, path).where((F.col("batch") == number - 1) & (F.col("kind") == "progress")).first()
        return last.seq + 1, last.done

    def add(batch: DataFrame, number: int) -> None:
        base, before = state(number)
        batch = batch.select(F.col("tile").cast("string").alias("tile"), F.col("points").cast("bigint").alias("points"), F.col("places").cast("bigint").alias("places")).persist()
        done = before + batch.count()
        row = lambda kind, at, n: F.struct(F.struct(F.lit(1).alias("a"), "tile", F.lit(at).alias("b")).alias("ord"), F.lit(kind).alias("kind"), "tile", F.col(n).alias("n"))
        each = batch.select(F.explode(F.when(F.col("places") > 0, F.array(row("tile", 0, "points"), row("places", 1, "places"))).otherwise(F.array(row("tile", 0, "points")))).alias("r")).select("r.*")
        each = each.withColumn("done", F.lit(None).cast("bigint")).withColumn("total", F.lit(None).cast("bigint"))
        ends = [((2, "", 0), "progress", None, None, done, total)] + ([((0, "", 0), "start", None, None, 0, total)] if number == 0 else [])
        extra = spark.createDataFrame(ends, "ord struct<a:int,tile:string,b:int>, kind string, tile string, n long, done long, total long")
        _numbered(each.unionByName(extra), base, f"{path}/batch={number}")
        batch.unpersist()

    q = tiles.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    log = read_log(spark, path)
    sums = log.agg(F.max("batch").alias("batch"), F.max("seq").alias("seq"), F.count_if(F.col("kind") == "tile").alias("tiles"), F.sum(F.when(F.col("kind") == "tile", F.col("n"))).alias("points"),
                   F.count_if(F.col("kind").isin("done", "error")).alias("ended")).first()
    kind = "done" if sums.tiles or held else "error"
    if not sums.ended:
        end = spark.createDataFrame([((sums.seq if sums.seq is not None else -1) + 1, kind, None, sums.points or 0, sums.tiles, total)], "seq long, kind string, tile string, n long, done long, total long")
        end.write.mode("overwrite").parquet(f"{path}/batch={(sums.batch if sums.batch is not None else -1) + 1}")
    return q


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log so far: LOG, in no order; seq has it."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(fs_path)) if fs.exists(fs_path) else []
    parts = [f"{path}/{n}" for n in names if n.startswith("batch=") and not n.endswith(".dealt")]
    if not parts:
        return spark.createDataFrame([], LOG)
    out = spark.read.schema(f"{LOG.split(', ', 1)[1]}, batch bigint").option("basePath", path).parquet(*parts)
    return out.select("batch", "seq", "kind", "tile", "n", "done", "total")


class PointReader(SimpleDataSourceStreamReader):
    """Rows of the Parquet files of a folder, in the order of their names, so many at a time.

    An offset is a file's number and a row in it. A batch ends with its file, so what lies between two offsets is
    one read of one file; it passes through the driver, which is why it is small. With the option batches, so many batches at most come
    together, each row with its batch's number at its end, and the offset counts the batches as well.
    """

    def __init__(self, options: dict[str, str]):
        self.most = int(options.get("points", PARTIAL))
        self.batches = int(options.get("batches", 0))
        path = options["path"]
        self.fs, at = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
        found = self.fs.get_file_info(pafs.FileSelector(at, recursive=True))
        self.files = sorted(i.path for i in found if i.type == pafs.FileType.File and i.path.endswith(".parquet"))

    def initialOffset(self) -> dict:
        return {"file": 0, "row": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at, row = start["file"], start["row"]
        while at < len(self.files):
            rows = self.rows(at, row, row + self.most * max(1, self.batches))
            if rows:
                end = {"file": at, "row": row + len(rows)}
                if self.batches:
                    end["batch"] = start.get("batch", 0) + -(-len(rows) // self.most)
                return self.numbered(rows, start), end
            if at + 1 == len(self.files):
                break  # stay at the last file's end, so that the offset does not move without rows
            at, row = at + 1, 0
        return iter([]), start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same rows again after a failure."""
        return self.numbered(self.rows(end["file"], start["row"] if start["file"] == end["file"] else 0, end["row"]), start)

    def numbered(self, rows: list[tuple], start: dict) -> Iterator[tuple]:
        if not self.batches:
            return iter(rows)
        return iter([(*r, start.get("batch", 0) + k // self.most) for k, r in enumerate(rows)])  # Spark copies the iterator

    def rows(self, number: int, first: int, last: int) -> list[tuple]:
        out, before = [], 0
        with self.fs.open_input_file(self.files[number]) as f:
            file = pq.ParquetFile(f)
            for g in range(file.num_row_groups):
                n = file.metadata.row_group(g).num_rows
                if before < last and before + n > first:
                    part = file.read_row_group(g).slice(max(0, first - before), min(last, before + n) - max(first, before))
                    out += list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                before += n
        return out


class Points(DataSource):
    """Format "lumenfold_points": a stream with the schema that it is given."""

    @classmethod
    def name(cls) -> str:
        return "lumenfold_points"

    def simpleStreamReader(self, schema: StructType) -> PointReader:
        return PointReader({**self.options})


def partial_points(spark: SparkSession, path: str, schema: str, points: int = PARTIAL, batches: int = 0) -> DataFrame:
    """A stream of the rows of the Parquet files below path, at most ``points`` for each micro-batch.

    batches: so many batches at most for each micro-batch instead, which costs far more than a batch of few points; schema
    then ends with an int, the row's batch from 0.
    """
    spark.dataSource.register(Points)
    return spark.readStream.format(Points.name()).schema(schema).option("points", points).option("batches", batches).load(path)


def run_in_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write each micro-batch of what is there to path/batch=N, and stop."""
    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


class Recent(StatefulProcessor):
    """What a client keeps: the tiles put or looked up last, at most ``most``; all of it goes when the watermark is ``idle`` seconds beyond its last row."""

    def __init__(self, most: int, idle: int):
        self.most, self.idle = most, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "tile string", "turn bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.kept.iterator()}
        kept = OrderedDict((k, None) for k in sorted(before, key=before.get))
        turn, out, touched = max(before.values(), default=-1) + 1, [], {}
        given = pd.concat(rows).sort_values(["us", "ord"])
        for r in given.itertuples():
            if r.tile in kept:
                kept.move_to_end(r.tile)
            elif not r.put:
                continue  # a look-up of what is not kept changes nothing
            kept[r.tile], touched[r.tile], turn = None, turn, turn + 1
            if len(kept) > self.most:
                out.append((r.ord, kept.popitem(last=False)[0]))
        for tile in before:
            if tile not in kept:
                self.kept.removeKey((tile,))
        for tile, n in touched.items():
            if tile in kept:
                self.kept.updateValue((tile,), (n,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.handle.registerTimer(int(given["us"].max()) // 1000 + 1000 * self.idle)
        yield pd.DataFrame({"client": [key[0]] * len(out), "ord": [a for a, _ in out], "evicted": [b for _, b in out], "size": [len(kept)] * len(out)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def evictions(events: DataFrame, most: int = KEPT, idle: int = 86_400, late: str = "1 day") -> DataFrame:
    """client, ord, evicted, size: what goes when a client's cache of ``most`` tiles is full, by the row (ord) that pushed it out.

    events: client bigint, tile string, put boolean (else a look-up), ts, ord bigint. Rows of a micro-batch are taken by (ts, ord). The tile used
    longest ago goes first. State is at most ``most`` tiles a client, and goes when the client is idle; rows that come more than ``late`` behind are dropped.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select("client", "tile", "put", "ts", F.unix_micros("ts").alias("us"), "ord").withWatermark("ts", late)
    return rows.groupBy("client").transformWithStateInPandas(Recent(most, idle), "client bigint, ord bigint, evicted string, size bigint", "Append", "EventTime")


class Changes(StatefulProcessor):
    """A job's rows: "job" for each new revision, "heartbeat" after ``pause`` seconds without one, "done" at a final status, then nothing more."""

    def __init__(self, pause: float, final: tuple[str, ...]):
        self.pause, self.final = pause, final

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "revision bigint, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get()
        revision, ended = before if before is not None else (None, False)
        out = []
        for r in sorted(rows, key=lambda r: r.revision):
            if ended or (revision is not None and r.revision <= revision):
                continue
            revision, ended = r.revision, r.status in self.final
            out += [(key[0], "job", revision, r.status)] + [(key[0], "done", revision, r.status)] * ended
        self.last.update((revision, ended))
        for t in list(self.handle.listTimers()) if before is not None else ():  # a new job has none
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if not ended:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.pause))
        return (Row(job=a, kind=b, revision=c, status=d) for a, b, c, d in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        revision, _ = self.last.get()
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.pause))
        yield Row(job=key[0], kind="heartbeat", revision=revision, status=None)

    def close(self) -> None:
        pass


def changes(jobs: DataFrame, pause: float = 1.0, final: Iterable[str] = ("completed", "failed", "cancelled", "interrupted")) -> DataFrame:
    """job, kind, revision, status of a stream of jobs (job bigint, revision bigint, status string).

    Revisions that are not above the last one are no change. Heartbeats come by the clock, so a query over changes() has batches
    without data for ever: start it with a trigger of its own (run_once() takes what is there in one batch).
    """
    jobs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = "job bigint, kind string, revision bigint, status string"
    return jobs.select("job", "revision", "status").groupBy("job").transformWithState(Changes(pause, tuple(final)), out, "Append", "ProcessingTime")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One micro-batch of what is there, as Parquet files below path, and stop."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(once=True).start()
    q.awaitTermination()
    return q


class Counts(StreamingQueryListener):
    """Rows read, by query name, as the session's listener bus reports them."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
