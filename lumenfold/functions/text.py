"""Strings: search, names that carry numbers, clocks and messages."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import D, col


@lru_cache(maxsize=1)
def _marked_letters() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks that decompose into one letter and marks, each with its letter; then the marks, which go."""
    marks = "".join(map(chr, range(0x300, 0x370)))
    found = {}
    for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if x not in marks)
        if len(base) == 1 and base != c:
            found[c] = base
    return "".join(found) + "".join(m for m in marks if m not in found), "".join(found.values())


def folded(c: D) -> Column:
    """Lower case without accents and other combining marks: by Unicode's decomposition, so letters that have none (ø, ł, ß) stay."""
    marked, plain = _marked_letters()
    return F.translate(F.lower(col(c)), marked, plain)


def match_score(text: D, needle: D) -> Column:
    """3 where the folded text starts with the needle, 2 where a word of it does, 1 where it holds it, else 0."""
    t, n = folded(text), folded(needle)
    words = F.split(t, r"[\s\-']+")
    return F.when(F.startswith(t, n), 3).when(F.exists(words, lambda w: F.startswith(w, n)), 2).when(F.contains(t, n), 1).otherwise(0)


_TILE = r"^e(-?\d+)_n(-?\d+)_s(\d+)$"


def tile_parts(tile_id: D) -> Column:
    """struct<e, n, size> of a tile id, null where it is none."""
    def part(k: int) -> Column:
        return F.regexp_extract(col(tile_id), _TILE, k).try_cast("bigint")

    return F.when(col(tile_id).rlike(_TILE), F.struct(part(1).alias("e"), part(2).alias("n"), part(3).alias("size")))


def compact_tile_id(tile_id: D) -> Column:
    """Column and row number of the tile, joined by ``_``; other strings stay as they are."""
    p = tile_parts(tile_id)
    fits = p.isNotNull() & (p["size"] > 0) & (p["e"] % p["size"] == 0) & (p["n"] % p["size"] == 0)
    number = lambda k: F.floor(p[k] / p["size"]).cast("bigint")
    return F.when(fits, F.concat_ws("_", number("e"), number("n"))).otherwise(col(tile_id))


def clock(c: D) -> Column:
    """The first HH:MM in the text, null where there is none."""
    found = F.regexp_extract(col(c), r"\b(\d{2}:\d{2})", 1)
    return F.when(found != "", found)


def minutes(c: D) -> Column:
    """Minutes since midnight of HH:MM, null where it is none."""
    ok = col(c).rlike(r"^\d{1,2}:\d{2}$")
    return F.when(ok, F.split(col(c), ":")[0].try_cast("int") * 60 + F.split(col(c), ":")[1].try_cast("int"))


def two_digits(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def clock_of(minute: D) -> Column:
    m = col(minute).cast("int")
    return F.concat(two_digits(F.floor(m / 60).cast("int")), F.lit(":"), two_digits(m % 60))


def raster_name(c: D) -> Column:
    """struct<year, east_km, north_km, resolution> of names like ``..._2021_2538-1152_0.5_...``, null otherwise."""
    form = r"_(\d{4})_(\d{4})-(\d{4})_(\d+(?:\.\d+)?)_"
    part = lambda k: F.regexp_extract(col(c), form, k)
    return F.when(
        col(c).rlike(form),
        F.struct(part(1).cast("int").alias("year"), part(2).cast("int").alias("east_km"), part(3).cast("int").alias("north_km"), part(4).cast("double").alias("resolution")),
    )


def raster_kind(c: D) -> Column:
    """Which surface a raster file holds, the first that fits: raw, composed, other."""
    low = F.lower(col(c))
    return F.when(low.rlike(r"raw"), "raw").when(low.rlike(r"compos"), "composed").otherwise("other")


def version(c: D) -> Column:
    """struct<major, minor, patch> of ``v1.2.3`` or ``name-v1.2.3``; it compares in version order. Null otherwise."""
    form = r"v?(\d+)\.(\d+)\.(\d+)$"
    part = lambda k: F.regexp_extract(col(c), form, k).try_cast("int")
    return F.when(col(c).rlike(form), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def valid_date(c: D) -> Column:
    """The date of YYYY-MM-DD; null for other forms and for days that the calendar lacks."""
    return F.when(col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), col(c).try_cast("date"))


def valid_clock(c: D) -> Column:
    return F.when(col(c).rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), col(c))
