"""Readers with explicit schemas: places, manifests, selections, indexes, elements and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tilefiles

PLACE = (
    "id string, source string, osm_type string, osm_id bigint, name string, category string, subcategory string, has_outdoor_seating boolean, "
    "has_outdoor_seating_unknown boolean, lat double, lon double, region string, tags map<string,string>"
)
PLACES_FILE = f"generated_at string, places array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in PLACE.replace('map<string,string>', 'map<string§string>').split(','))}>>".replace("§", ",")
ELEMENT = "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
MANIFEST = "region string, hash string, day string, grid_step int, start string, end string, tile_ids array<string>, failed array<string>, complete boolean"
SELECTION = "region string, tile_id string, score double, `group` string"


def places(spark: SparkSession, folder: str, region: str | None = None) -> DataFrame:
    """Places of all ``*-places.json`` files of a folder, one row for each id: the last file by name wins.

    A file (or a folder of part files) called ``all-places.json`` is the others' union and is passed over.
    """
    files = spark.read.schema(PLACES_FILE).option("multiLine", True).json(f"{folder}/*-places.json").withColumn("__file", F.input_file_name())
    rows = files.where(~F.col("__file").contains("/all-places.json")).select("__file", F.explode("places").alias("p"))
    if region:
        rows = rows.where(F.col("p.region") == region)
    return rows.groupBy("p.id").agg(F.max_by("p", "__file").alias("p")).select("p.*")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of raw map extracts ({"elements": [...]})."""
    inner = ELEMENT.replace("type string", "type:string").replace("id bigint", "id:bigint").replace("lat double", "lat:double", 1).replace("lon double", "lon:double", 1)
    inner = inner.replace("center struct", "center:struct").replace("tags map", "tags:map")
    return spark.read.schema(f"elements array<struct<{inner}>>").option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")


def extract_query(south: float, west: float, north: float, east: float, amenities: tuple[str, ...], seconds: int = 120) -> str:
    """The extract service's query for venues and parks in a box."""
    box = f"({south},{west},{north},{east})"
    kinds = "|".join(amenities)
    return f'[out:json][timeout:{seconds}];(nwr["amenity"~"^({kinds})$"]{box};nwr["leisure"="park"]{box};);out center tags;'


def unreadable_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes of the manifests that manifests() cannot read: broken JSON, or no region."""
    rows = spark.read.schema(f"{MANIFEST}, _broken string").option("recursiveFileLookup", True).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(folder)
    return rows.select(F.input_file_name().alias("file"), "region", "_broken").where("region is null or _broken is not null").select("file", F.octet_length("_broken").alias("bytes"))


def manifests(spark: SparkSession, folder: str, region: str | None = None, hash_: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Run manifests below a folder, by region, hash and dates (inclusive, either end open). Unreadable files are left out; unreadable_manifests() names them."""
    out = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder).where("region is not null")
    for column, value in (("region", region), ("hash", hash_)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if first is not None:
        out = out.where(F.col("day") >= first)
    return out if last is None else out.where(F.col("day") <= last)


def ranked_hashes(runs: DataFrame, current: str | None = None) -> DataFrame:
    """region, hash, runs, rank: the current hash first, then by how many runs each has, then by name."""
    counts = runs.groupBy("region", "hash").agg(F.count("*").alias("runs"))
    w = Window.partitionBy("region").orderBy((F.col("hash").eqNullSafe(F.lit(current))).desc(), F.desc("runs"), "hash")
    return counts.withColumn("rank", F.row_number().over(w))


def selection(spark: SparkSession, path: str, known: DataFrame, groups: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Selected tiles that are known, and those that are not, of JSON lines."""
    rows = spark.read.schema(SELECTION).json(path)
    if groups:
        rows = rows.where(F.col("group").isin(*groups))
    return rows.join(known.select("tile_id"), "tile_id", "left_semi"), rows.join(known.select("tile_id"), "tile_id", "left_anti")


def index_buckets(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The angle index (Parquet), all of it or the buckets (az_b, alt_b) asked for.

    Up to 1000 buckets become a predicate that row groups are pruned by; more are joined.
    """
    rows = spark.read.parquet(path)
    if keys is None:
        return rows
    some = keys.select("az_b", "alt_b").distinct()
    few = some.limit(1001).collect()
    if len(few) > 1000:
        return rows.join(some, ["az_b", "alt_b"], "left_semi")
    wanted = F.struct("az_b", "alt_b").isin(*(F.struct(F.lit(r.az_b), F.lit(r.alt_b)) for r in few)) if few else F.lit(False)
    within = F.col("alt_b").between(min((r.alt_b for r in few), default=0), max((r.alt_b for r in few), default=-1))
    return rows.where(within & wanted)


def index_keys(spark: SparkSession, path: str) -> DataFrame:
    """Which buckets each tile has: a scan of the key columns alone."""
    return spark.read.parquet(path).select("tile_id", "az_b", "alt_b").distinct()


def index_keys_beside(spark: SparkSession, keys: str, index: str) -> DataFrame:
    """tile_id, alt_b, az_b of every bucket: from the keys written beside the index, whose broken or half-written files are
    passed over; tiles without keys there are read from the index itself (its key columns alone)."""
    schema = "tile_id string, held array<struct<alt_b:int,az_b:int>>"
    beside = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(keys).where("tile_id is not null and held is not null")
    lost = spark.read.parquet(index).select("tile_id", "alt_b", "az_b").join(beside.select("tile_id"), "tile_id", "left_anti").distinct()
    return beside.select("tile_id", F.explode("held").alias("k")).select("tile_id", "k.alt_b", "k.az_b").distinct().unionByName(lost)


def dated_tiles(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """day, tile, points, frames of tile artifacts stored by day, within the days first to last (inclusive, either end open).

    Folders of other days are not listed among the files to read. A damaged artifact fails the job.
    """
    rows = spark.read.schema("tile string, artifact binary, day date").parquet(path)
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
    key = F.concat_ws("|", F.col("day").cast("string"), "tile").alias("key")
    out = tilefiles.decoded(rows.select(key, "artifact"), "key")
    return out.select(F.to_date(F.substring("key", 1, 10)).alias("day"), F.expr("substring(key, 12)").alias("tile"), "points", "frames")


def file_sizes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """folder, files, bytes below a folder, from the listing; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def degree_cells(boxes: DataFrame) -> DataFrame:
    """The whole-degree elevation cells (south, west) that each box meets."""
    n = lambda a: F.explode(F.sequence(F.floor(f"min_{a}").cast("int"), F.greatest(F.floor(f"min_{a}"), F.ceil(f"max_{a}") - 1).cast("int")))
    return boxes.withColumn("south", n("lat")).withColumn("west", n("lon"))
