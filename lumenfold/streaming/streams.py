"""Streaming forms: windows, accumulation, coalescing and exclusion over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import delete


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    """A stream of the Parquet files in a folder, so many for each micro-batch, ts as an instant."""
    out = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in out.columns else out


def sunny_sessions(samples: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """point, start, end, samples of sunny runs without a gap, as a stream with a watermark.

    An addition to the batch operator: runs end by a pause between sunny samples, and
    rows that come later than the watermark are dropped.
    """
    sunny = samples.where("is_sunny").withWatermark("ts", late)
    out = sunny.groupBy(F.session_window("ts", gap).alias("w"), "point").agg(F.count("*").alias("samples"))
    return out.select("point", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples")


def sunny_minutes(samples: DataFrame, step_minutes: int, late: str = "1 day") -> DataFrame:
    """point, day, minutes: a stateful sum that a checkpointed query resumes where it stopped."""
    return (
        samples.withWatermark("ts", late).where("is_sunny").groupBy(F.window("ts", "1 day").alias("w"), "point")
        .agg((F.count("*") * step_minutes).alias("minutes")).select("point", F.to_date("w.start").alias("day"), "minutes")
    )


def without_held(tiles: DataFrame, held: DataFrame, key: str = "tile_id") -> DataFrame:
    """A stream of tiles without those that the client holds (a static table)."""
    marked = held.select(key).distinct().withColumn("__held", F.lit(True))
    return tiles.join(marked, key, "left").where("__held is null").drop("__held")


def accepted(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """key, ts of events at least so long after the last accepted one of their key, with that one as state.

    Events of a micro-batch are taken in order of time; one that is older than the
    state is not accepted.
    """
    micros = int(seconds * 1e6)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(t for part in parts for t in part["us"].tolist()):
            if last is None or t - last >= micros:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), "us": kept})

    kind = events.schema[key].dataType.simpleString()
    out = events.select(key, F.unix_micros("ts").alias("us")).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, us bigint", "last bigint", "append", GroupStateTimeout.NoTimeout
    )
    return out.select(key, F.timestamp_micros("us").alias("ts"))


def run_to(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off all that is there into a table in memory, and stop."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Work off all that is there into Parquet files of the shared file system, and stop. A batch is written once."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def accumulate(stream: DataFrame, path: str, checkpoint: str, keys: list[str], value: str) -> StreamingQuery:
    """Fold a stream into a Parquet table of sums by key, once for each micro-batch.

    The table is written anew beside the old one, under the batch's number, so a
    batch that is repeated after a failure gives the same table. Tables before the last two go.
    """
    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sums = batch.groupBy(*keys).agg(F.sum(value).alias(value))
        if number:
            sums = spark.read.parquet(f"{path}/batch={number - 1}").select(*keys, value).unionByName(sums).groupBy(*keys).agg(F.sum(value).alias(value))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number > 1:
            delete(spark, f"{path}/batch={number - 2}")

    q = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
