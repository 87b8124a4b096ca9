"""Ordered operators: contiguous runs, ranks, running values and folds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import cut
from .spatial import small


def islands(df: DataFrame, keys: list[str], order: list, value: Column, name: str = "island") -> DataFrame:
    """Number the runs of equal value within each key: equal (keys, value, island) means one contiguous run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = Window.partitionBy(*keys, "__v").orderBy(*order)
    out = df.withColumn("__v", value)
    return out.withColumn(name, F.row_number().over(w) - F.row_number().over(same)).drop("__v")


def sunny_windows(samples: DataFrame, step_minutes: int, keys: tuple[str, ...] = ("point",), order: tuple[str, ...] = ("ts", "ord")) -> DataFrame:
    """keys, start, end, minutes of every contiguous sunny run of samples (keys, ts, is_sunny).

    A run starts with its first sunny sample and ends at the first sample after it
    that is not sunny; one that is still open ends a step after its last sample.
    minutes is the number of its samples times the step.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.expr(f"interval {step_minutes} minutes")
    after = samples.withColumn("__next", F.coalesce(F.lead("ts").over(w), F.col("ts") + step))
    runs = islands(after, list(keys), list(order), F.col("is_sunny")).where("is_sunny")
    return runs.groupBy(*keys, "island").agg(
        F.min("ts").alias("start"), F.max("__next").alias("end"), (F.count("*") * step_minutes).alias("minutes")
    ).drop("island")


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each key in a total order, with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def accepted_events(df: DataFrame, keys: list[str], at: str, seconds: float, keep: int | None = None) -> DataFrame:
    """keys and instants that come at least ``seconds`` after the last accepted one of their key; keep: only so many last ones.

    Whether an event is accepted depends on the last accepted one, not on its predecessor,
    so each key's instants pass through one task in order; the task remembers the last one only.
    """
    gap, us = int(seconds * 1e6), "__us"
    rows = df.select(*keys, F.unix_micros(F.col(at)).alias(us)).repartition(*keys).sortWithinPartitions(*keys, us)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last = None
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            taken = []
            for i, t in enumerate(batch.column(us).to_pylist()):
                if t is None:
                    continue
                if own[i] != key or last is None or t - last >= gap:
                    key, last = own[i], t
                    taken.append(i)
            yield batch.take(pa.array(taken, pa.int64()))

    out = rows.mapInArrow(run, rows.schema)
    if keep:
        out = out.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(us)))).where(F.col("__k") <= keep)
    return out.select(*keys, F.timestamp_micros(us).alias(at))


def floored_sums(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "now") -> DataFrame:
    """df with the running sum of value by key, where the sum is put back to 0 whenever it would go below.

    The sum so far less its lowest point (or 0) is the same without a fold.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__s", F.sum(value).over(w))
    return out.withColumn(name, F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).drop("__s")


def nearest_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, float], bins: int = 4096) -> DataFrame:
    """keys with, for each name and q of ranks, element floor(q * n) of the key's sorted values (the last at most), without interpolation.

    Two passes: counts by bin between each key's least and greatest value find the bin that
    holds a rank, then the distinct values of those bins are counted. So no key's values are
    gathered or sorted in one place, and rows meet keys and bins where they are. Nulls do not count.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
    span = small(cut(rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__n"))))
    step = F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins)
    binned = rows.join(span, keys).withColumn("__bin", F.least(F.lit(bins - 1), F.coalesce(F.when(F.col("__hi") > F.col("__lo"), step), F.lit(0))).cast("int"))
    upto = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.groupBy(*keys, "__bin").agg(F.count("*").alias("__k"), F.first("__n").alias("__n")).withColumn("__upto", F.sum("__k").over(upto))
    asked = F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.col("__n"), F.floor(F.lit(float(q)) * F.col("__n")) + 1).alias("rank")) for name, q in ranks.items()))
    at = counts.withColumn("__q", F.explode(asked)).where((F.col("__q.rank") <= F.col("__upto")) & (F.col("__q.rank") > F.col("__upto") - F.col("__k")))
    at = small(cut(at.select(*keys, "__bin", F.col("__q.name").alias("__name"), (F.col("__q.rank") - F.col("__upto") + F.col("__k")).alias("__rank"))))
    held = binned.join(at, [*keys, "__bin"]).groupBy(*keys, "__name", "__rank", "__v").agg(F.count("*").alias("__k"))
    run = Window.partitionBy(*keys, "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    found = held.withColumn("__upto", F.sum("__k").over(run)).where("__upto >= __rank").groupBy(*keys, "__name").agg(F.min("__v").alias("__v"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks))
