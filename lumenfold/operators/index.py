"""The angle index: verdicts kept by sun-angle bucket instead of by date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sun
from .windows import first_by

#: A horizon profile has one row for each whole degree, so it may always be broadcast.
PROFILE_BINS = 360


def horizon_blocked(samples: DataFrame, profile: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """samples (az_bin, altitude, keys) with blocked: the sun is not above the profile (keys, az_bin, angle).

    Without keys the profile has 360 rows and is broadcast; with keys it is joined on them.
    """
    side = profile if keys else F.broadcast(profile)
    return samples.join(side, [*keys, "az_bin"]).withColumn("blocked", F.col("altitude") <= F.col("angle"))


def target_buckets(sun_positions: DataFrame, resolution: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct buckets (keys, az_b, alt_b) of the positions above the horizon."""
    up = sun_positions.where("altitude > 0")
    return up.select(*keys, sun.bucket("azimuth", resolution).alias("az_b"), sun.bucket("altitude", resolution).alias("alt_b")).distinct()


def dedup_factor(sun_positions: DataFrame, resolutions: tuple[float, ...]) -> DataFrame:
    """resolution, frames, buckets, factor: how many frames share a bucket on average."""
    up = sun_positions.where("altitude > 0").withColumn("resolution", F.explode(F.array(*map(F.lit, resolutions))))
    b = F.struct(F.floor(F.col("azimuth") / F.col("resolution")), F.floor(F.col("altitude") / F.col("resolution")))
    return up.groupBy("resolution").agg(F.count("*").alias("frames"), F.countDistinct(b).alias("buckets")).withColumn("factor", F.col("frames") / F.col("buckets"))


def missing_buckets(target: DataFrame, existing: DataFrame) -> DataFrame:
    return target.distinct().join(existing.distinct(), target.columns, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: new ones win over old ones, the first in order within a side. src: 0 new, 1 old."""
    both = new.withColumn("src", F.lit(0)).unionByName(old.withColumn("src", F.lit(1)))
    return first_by(both, keys, [F.col("src"), *map(F.col, order)], rank="__r").drop("__r")


def without_drifted(old: DataFrame, old_width: DataFrame, new_width: DataFrame, key: str) -> DataFrame:
    """old without the keys whose width (key, w) is another in new: their masks cannot be merged."""
    changed = old_width.join(new_width.withColumnRenamed("w", "w2"), key).where("w <> w2").select(key)
    return old.join(changed, key, "left_anti")


def coverage(have: DataFrame, need: DataFrame, key: str, on: list[str]) -> DataFrame:
    """key, present, needed, covered: how many of the needed rows each key has.

    Only rows that are needed are counted; the needed ones are one number for all keys.
    """
    need = need.distinct()
    total = need.agg(F.count("*").alias("needed"))
    present = have.select(key, *on).distinct().join(need.withColumn("__n", F.lit(1)), on, "left").groupBy(key).agg(F.count("__n").alias("present"))
    return present.join(F.broadcast(total)).withColumn("covered", F.col("present") == F.col("needed"))


def cascade(samples: DataFrame, levels: dict[float, DataFrame], angle: str, bucket: str, value: str) -> DataFrame:
    """samples with the value of the first level (resolution: rows of bucket and value) that has their bucket, and its resolution."""
    out = samples
    values: list[Column] = []
    for k, (resolution, rows) in enumerate(levels.items()):
        side = rows.select(F.col(bucket).alias(f"__b{k}"), F.col(value).alias(f"__v{k}"))
        out = out.join(side, sun.bucket(angle, resolution) == F.col(f"__b{k}"), "left")
        values.append(F.when(F.col(f"__v{k}").isNotNull(), F.struct(F.col(f"__v{k}").alias("v"), F.lit(resolution).alias("r"))))
    best = F.coalesce(*values)
    return reduce(lambda d, k: d.drop(f"__b{k}", f"__v{k}"), range(len(levels)), out.withColumn("__best", best)).withColumn(value, F.col("__best.v")).withColumn("resolution", F.col("__best.r")).drop("__best")
