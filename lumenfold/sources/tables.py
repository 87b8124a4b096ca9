"""The standard tables, and the logical tables of the domain derived from them.

Every derived table is a plain projection, so that filters and column pruning
reach the Parquet scan. SQL says the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import pack_array

#: Bounding boxes of the regions served, in the order in which they are tried. (Fixed values.)
REGIONS = (
    ("lausanne", 6.54, 46.49, 6.74, 46.62),
    ("nyon", 6.14, 46.33, 6.33, 46.45),
    ("morges", 6.44, 46.48, 6.55, 46.54),
    ("geneve", 6.05, 46.15, 6.25, 46.26),
    ("vevey", 6.715, 46.468, 6.795, 46.541),
    ("vevey_city", 6.82, 46.44, 6.89, 46.49),
    ("neuchatel", 6.84, 46.95, 7.02, 47.07),
    ("la_chaux_de_fonds", 6.79, 47.085, 6.86, 47.12),
    ("bern", 7.42, 46.93, 7.48, 46.97),
    ("zurich", 8.4974, 47.359, 8.58, 47.403),
    ("thun", 7.5986, 46.7347, 7.66, 46.78),
)

LAT, LON = 46.52, 6.63


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def regions(self) -> DataFrame:
        rows = [(n, k, *box) for k, (n, *box) in enumerate(REGIONS)]
        return self.spark.createDataFrame(rows, "region string, ord int, min_lon double, min_lat double, max_lon double, max_lat double")

    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def samples(self) -> DataFrame:
        """sample(point, ts, ord, is_sunny)"""
        return self.events().select(F.col("user_id").alias("point"), "ts", F.col("event_id").alias("ord"), (F.col("event_type") != "error").alias("is_sunny"))

    def places(self) -> DataFrame:
        k = F.col("c_custkey")
        sub = F.when(F.col("c_mktsegment") == "BUILDING", "restaurant").when(F.col("c_mktsegment") == "MACHINERY", "bar").when(
            F.col("c_mktsegment") == "AUTOMOBILE", "fast_food").when(F.col("c_mktsegment") == "HOUSEHOLD", "cafe").otherwise("park")
        return self.read("customer").select(
            k.alias("id"), F.col("c_name").alias("name"), F.when(sub == "park", "park").otherwise("terrace_candidate").alias("category"), sub.alias("subcategory"),
            (F.col("c_acctbal") > 0).alias("seating"), (F.lit(6.54) + (k % 200) * 0.001).alias("lon"), (F.lit(46.49) + (F.floor(k / 200) % 130) * 0.001).alias("lat"),
        )

    def obstacles(self) -> DataFrame:
        k, h = F.col("p_partkey"), 1 + F.col("p_size") % 9
        x, y = (k % 50) * 20.0, (F.floor(k / 50) % 40) * 20.0
        return self.read("part").select(
            k.alias("id"), (x - h).alias("min_x"), (y - h).alias("min_y"), (x + h).alias("max_x"), (y + h).alias("max_y"), F.lit(0.0).alias("min_z"),
            (5.0 + F.col("p_size")).alias("max_z"), x.alias("center_x"), y.alias("center_y"), (h * F.lit(2.0**0.5)).alias("half_diagonal"), F.col("p_brand").alias("source"),
        )

    def probes(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.read("supplier").select(k.alias("probe"), (k * 9.7).alias("x"), (k * 7.3).alias("y"), F.lit(0.0).alias("z"), ((k * 37) % 360).cast("double").alias("azimuth"), (5 + k % 50).cast("double").alias("altitude"))

    def horizon(self) -> DataFrame:
        """horizon(az_bin, angle)"""
        return self.read("part").groupBy((F.col("p_partkey") % 360).cast("int").alias("az_bin")).agg((F.max("p_retailprice") / 100).alias("angle"))

    def buckets(self) -> DataFrame:
        """bucket(tile, az_b, alt_b, version, ord, line, value)"""
        return self.read("lineitem").select(
            (F.col("l_suppkey") % 20).alias("tile"), (F.col("l_partkey") % 480).cast("int").alias("az_b"), F.col("l_linenumber").cast("int").alias("alt_b"),
            F.col("l_shipdate").cast("timestamp").alias("version"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("value"),
        )

    def runs(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("region"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("size"),
            F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("owner"),
        )

    def masks(self) -> DataFrame:
        """mask(vec_id, label, i, bit)"""
        return self.read("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).select("vec_id", "label", "i", (F.col("v") > 0).alias("bit"))

    def packed(self) -> DataFrame:
        """packed(vec_id, label, mask): the 64 signs of an embedding as one long, bit i for element i."""
        return self.read("embeddings").select("vec_id", "label", pack_array(F.transform("embedding", lambda v: v > 0)).alias("mask"))


# The same tables as common table expressions for DuckDB.
_REGION_ROWS = ", ".join(f"('{n}', {k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for k, (n, a, b, c, d) in enumerate(REGIONS))
SQL = {
    "regions_": f"SELECT * FROM (VALUES {_REGION_ROWS}) v(region, ord, min_lon, min_lat, max_lon, max_lat)",
    "samples": "SELECT user_id AS point, CAST(ts AS TIMESTAMP) AS ts, event_id AS ord, event_type <> 'error' AS is_sunny FROM events",
    "places": """SELECT c_custkey AS id, c_name AS name, CASE WHEN sub = 'park' THEN 'park' ELSE 'terrace_candidate' END AS category, sub AS subcategory, c_acctbal > 0 AS seating,
        6.54e0 + (c_custkey % 200) * 1e-3 AS lon, 46.49e0 + (c_custkey // 200 % 130) * 1e-3 AS lat
        FROM (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 'restaurant' WHEN 'MACHINERY' THEN 'bar' WHEN 'AUTOMOBILE' THEN 'fast_food' WHEN 'HOUSEHOLD' THEN 'cafe' ELSE 'park' END AS sub FROM customer)""",
    "obstacles": """SELECT id, x - h AS min_x, y - h AS min_y, x + h AS max_x, y + h AS max_y, 0e0 AS min_z, 5e0 + p_size AS max_z, x AS center_x, y AS center_y, h * 1.4142135623730951e0 AS half_diagonal, p_brand AS source
        FROM (SELECT *, p_partkey AS id, 1 + p_size % 9 AS h, (p_partkey % 50) * 20e0 AS x, (p_partkey // 50 % 40) * 20e0 AS y FROM part)""",
    "probes": "SELECT s_suppkey AS probe, s_suppkey * 9.7e0 AS x, s_suppkey * 7.3e0 AS y, 0e0 AS z, CAST((s_suppkey * 37) % 360 AS DOUBLE) AS azimuth, CAST(5 + s_suppkey % 50 AS DOUBLE) AS altitude FROM supplier",
    "horizon": "SELECT CAST(p_partkey % 360 AS INTEGER) AS az_bin, max(p_retailprice) / 100 AS angle FROM part GROUP BY 1",
    "buckets": "SELECT l_suppkey % 20 AS tile, CAST(l_partkey % 480 AS INTEGER) AS az_b, CAST(l_linenumber AS INTEGER) AS alt_b, CAST(l_shipdate AS TIMESTAMP) AS version, l_orderkey AS ord, l_linenumber AS line, l_quantity AS value FROM lineitem",
    "runs": "SELECT o_orderkey AS run, o_orderstatus AS region, CAST(o_orderdate AS DATE) AS day, o_totalprice AS size, o_orderpriority AS priority, o_custkey AS owner FROM orders",
    "masks": "SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS i, embedding[i] > 0 AS bit FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)",
}


def sql(body: str, *names: str) -> str:
    """The statement with the named logical tables in front of it."""
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    lead = f"WITH {ctes}" if ctes else ""
    if lead and body.lstrip().upper().startswith("WITH "):
        return f"{lead}, {body.lstrip()[5:]}"
    return f"{lead} {body}"
