"""Writers: partitioned indexes, exports, mask blobs and purge plans."""

from __future__ import annotations

import base64
import gzip
import uuid

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_index(buckets: DataFrame, path: str, rows_per_file: int = 1_000_000, mode: str = "overwrite") -> None:
    """Write the angle index by region and resolution, each part sorted by (alt_b, az_b).

    Parts are dealt by range of tile and bucket, so that files have narrow bounds and
    readers can pass over row groups; zstd, and at most so many rows in a file.
    """
    dealt = buckets.repartitionByRange("region", "res", "tile_id", "alt_b", "az_b").sortWithinPartitions("region", "res", "tile_id", "alt_b", "az_b")
    dealt.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("region", "res").parquet(path)


def write_index_keys(buckets: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write which buckets each tile of the angle index has: a row for each tile, beside the index, far smaller than it."""
    held = F.array_sort(F.collect_set(F.struct("alt_b", "az_b")))
    buckets.groupBy("tile_id").agg(held.alias("held")).write.mode(mode).option("compression", "zstd").parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares: the session's checkpoint folder, else under its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a path from whatever file system it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_shards(buckets: DataFrame, path: str, per_shard: int = 16) -> None:
    """Write the angle index in shards of so many consecutive buckets (az_b, alt_b) of a tile, with the shard as a column.

    A shard is one row group's worth of neighbours: parts are dealt by tile and shard and sorted by bucket.
    """
    rank = F.dense_rank().over(Window.partitionBy("tile_id").orderBy("alt_b", "az_b")) - 1
    dealt = buckets.withColumn("shard", F.floor(rank / per_shard).cast("int")).repartition("tile_id", "shard").sortWithinPartitions("tile_id", "shard", "alt_b", "az_b")
    dealt.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_places(places: DataFrame, folder: str, file: str) -> None:
    """Places (with the reader's columns, or some of them) as ``<region>-places.json`` documents, one for each region, or
    as one called ``file``; a document is one JSON object, so its places are gathered."""
    own = [c for c in places.columns if c != "__file"]
    doc = places.groupBy("__file" if "__file" in places.columns else F.lit(file).alias("__file")).agg(F.lit("now").alias("generated_at"), F.collect_list(F.struct(*own)).alias("places"))
    doc.select("generated_at", "places").write.mode("overwrite").option("maxRecordsPerFile", 1).json(f"{folder}/{file}-places.json")


def write_by_region(places: DataFrame, path: str) -> None:
    places.write.mode("overwrite").partitionBy("region").json(path)


def feature(row: list[str], lon: str = "lon", lat: str = "lat") -> Column:
    """A GeoJSON feature of a point, with the named columns as properties."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*row).alias("properties")))


def write_features(places: DataFrame, path: str, columns: list[str]) -> None:
    """One feature on each line, which stays splittable at any size (a collection is their concatenation)."""
    places.select(feature(columns).alias("value")).write.mode("overwrite").text(path)


@F.pandas_udf(T.StringType())
def mask_blob(masks: pd.Series) -> pd.Series:
    """array<binary> of masks to base64 of their gzipped concatenation (equal masks, equal blobs)."""
    return masks.map(lambda m: base64.b64encode(gzip.compress(b"".join(m), mtime=0)).decode() if m is not None else None)


@F.pandas_udf(T.BinaryType())
def unblob(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: gzip.decompress(base64.b64decode(b)) if b is not None else None)


#: First bytes of the two compressed forms. (Fixed values.)
GZIP_MAGIC, ZSTD_MAGIC = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"


@F.pandas_udf(T.BinaryType())
def decompressed(blob: pd.Series) -> pd.Series:
    """Blobs of any of three forms, told by their first bytes: gzip, zstd or plain."""

    def plain(b: bytes | None) -> bytes | None:
        if b is None:
            return None
        if b[:2] == GZIP_MAGIC:
            return gzip.decompress(b)
        return zstandard.ZstdDecompressor().decompressobj().decompress(b) if b[:4] == ZSTD_MAGIC else bytes(b)

    return blob.map(plain)


def compressed(codec: str):
    """A UDF that compresses binaries with gzip or zstd; the same bytes on every run."""

    @F.pandas_udf(T.BinaryType())
    def pack(blob: pd.Series) -> pd.Series:
        return blob.map(lambda b: None if b is None else gzip.compress(b, mtime=0) if codec == "gzip" else zstandard.ZstdCompressor().compress(b))

    return pack


def purge(spark: SparkSession, path: str, plan: DataFrame, dry_run: bool = True) -> int:
    """Delete the partitions of the plan (its columns are the partition columns, in order) below path; how many there are."""
    n = 0
    for row in plan.toLocalIterator():
        n += 1
        if not dry_run:
            delete(spark, path + "".join(f"/{c}={row[c]}" for c in plan.columns))
    return n


def purge_plan(runs: DataFrame, region: str | None = None, before: str | None = None, keep_hash: str | None = None) -> DataFrame:
    """The partitions (region, hash, day) that a purge would delete; nothing is deleted."""
    out = runs.select("region", "hash", "day").distinct()
    if region is not None:
        out = out.where(F.col("region") == region)
    if before is not None:
        out = out.where(F.col("day") < before)
    return out if keep_hash is None else out.where(F.col("hash") != keep_hash)
