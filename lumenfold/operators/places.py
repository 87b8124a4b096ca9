"""Venues: normalising, classifying, filtering, scoring and searching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import half_up
from .windows import first_by

VENUES = ("cafe", "bar", "pub", "restaurant", "biergarten", "fast_food", "food_court")
DRINKS, SNACKS, MEALS = ("bar", "pub", "biergarten"), ("fast_food", "food_court"), ("restaurant", "cafe")


def tag(name: str, tags: str = "tags") -> Column:
    return F.try_element_at(F.col(tags), F.lit(name))


def normalise(elements: DataFrame, region: str) -> DataFrame:
    """Map elements (type, id, lat, lon, center struct<lat,lon>, tags) as venues and parks.

    Others, and elements without coordinates, are left out. Seating outdoors is true
    for ``yes``; unknown (of a venue) is told apart from ``no``.
    """
    lat, lon = F.coalesce("lat", "center.lat"), F.coalesce("lon", "center.lon")
    park = F.coalesce(tag("leisure") == "park", F.lit(False))
    kind = F.when(park, "park").when(tag("amenity").isin(*VENUES), tag("amenity"))
    covered = tag("outdoor_seating:covered")
    out = elements.withColumn("subcategory", kind).where(F.col("subcategory").isNotNull() & lat.isNotNull() & lon.isNotNull())
    return out.select(
        F.concat_ws(":", F.lit("osm"), "type", "id").alias("id"), F.lit("osm").alias("source"), F.col("type").alias("osm_type"), F.col("id").alias("osm_id"),
        F.coalesce(tag("name"), F.concat_ws("-", "subcategory", "type", "id")).alias("name"),
        F.when(F.col("subcategory") == "park", "park").otherwise("terrace_candidate").alias("category"), "subcategory",
        F.coalesce(tag("outdoor_seating") == "yes", F.lit(False)).alias("has_outdoor_seating"),
        ((F.col("subcategory") != "park") & tag("outdoor_seating").isNull()).alias("has_outdoor_seating_unknown"),
        F.when(covered.isin("yes", "no", "partial"), covered).alias("outdoor_seating_covered"),
        F.when(tag("outdoor_seating:heated") == "yes", True).alias("outdoor_seating_heated"),
        half_up(lat, 6).alias("lat"), half_up(lon, 6).alias("lon"), F.lit(region).alias("region"), "tags",
    )


def venue_type(name: Column, subcategory: Column, tags: Column | None = None) -> Column:
    """foodtruck, bar, snack, restaurant or other, by the first rule that fits."""
    get = lambda k: F.try_element_at(tags, F.lit(k)) if tags is not None else F.lit(None).cast("string")
    sub, amenity = F.lower(subcategory), F.lower(F.coalesce(get("amenity"), F.lit("")))
    truck = F.contains(F.lower(name), F.lit("truck"))
    for k in ("food_truck", "mobile", "street_vendor"):
        truck = truck | F.coalesce(get(k) == "yes", F.lit(False))
    out = F.when(truck, "foodtruck")
    for kind in (sub, amenity):
        out = out.when(kind.isin(*DRINKS), "bar").when(kind.isin(*SNACKS), "snack").when(kind.isin(*MEALS), "restaurant")
    return out.otherwise("other")


def chosen(
    places: DataFrame, category: str | None = None, seated: bool = False, subcategories: tuple[str, ...] = (), ids: tuple = (), box: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """places that meet every condition given; subcategories without regard to case; box: west, south, east, north."""
    out = places
    if category:
        out = out.where(F.col("category") == category)
    if seated:
        out = out.where("seating")
    if subcategories:
        out = out.where(F.lower("subcategory").isin(*(s.lower() for s in subcategories)))
    if ids:
        out = out.where(F.col("id").isin(*ids))
    if box:
        out = out.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    return out


def confirmed(places: DataFrame) -> DataFrame:
    """Venues known to have seats outdoors: no parks, no food courts."""
    return places.where((F.col("category") != "park") & (F.col("subcategory") != "food_court") & F.col("seating"))


def weight(category: Column, subcategory: Column, seating: Column) -> Column:
    """How much a place counts for its tile: parks 3, venues 2 and more with seats or by kind."""
    extra = F.when(subcategory.isin(*DRINKS), 2).when(subcategory.isin("cafe", "restaurant"), 1).otherwise(0)
    return F.when(category == "park", 3).otherwise(2 + F.when(seating, 4).otherwise(0) + extra)


def tile_scores(places: DataFrame, keys: list[str], samples: int = 8) -> DataFrame:
    """For each tile: score, places, seated, parks and the first names (by name, then id)."""
    w = weight(F.col("category"), F.col("subcategory"), F.col("seating"))
    sums = places.groupBy(*keys).agg(
        F.sum(w).alias("score"), F.count("*").alias("places"), F.count_if("seating").alias("seated"), F.count_if(F.col("category") == "park").alias("parks")
    )
    # A rank's limit is applied before the shuffle too, so no tile's names are all gathered.
    few = first_by(places.select(*keys, "name", "id"), keys, [F.col("name"), F.col("id")], samples, "__rank")
    names = few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "name"))), lambda n: n["name"]).alias("names"))
    return sums.join(names, keys)


def histogram(rows: DataFrame, keys: list[str], of: str) -> DataFrame:
    """keys and a map of value to count, in order of value."""
    counts = rows.groupBy(*keys, of).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(of, "n")))).alias("counts"))


def suggest(places: DataFrame, needle: str, n: int = 20) -> DataFrame:
    """The n best matches of a search (1 to 20): by score, then name and id."""
    scored = places.withColumn("score", text.match_score("name", F.lit(needle))).where("score > 0")
    return scored.orderBy(F.desc("score"), "name", "id").limit(max(1, min(20, n)))


def clusters(places: DataFrame, size: float) -> DataFrame:
    """Cells of a pixel grid over x and y: how many places each holds and the lowest id as its anchor."""
    return places.groupBy(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(F.count("*").alias("n"), F.min("id").alias("anchor"))
