"""Opening hours: weekly rules in the map community's notation, as column expressions.

Understood are rules separated by ``;``, each of days (``Mo``, ``Mo-Fr``, lists of
both) and times (``08:00-12:00,14:00-22:00``, ``off``, ``closed``), times alone (every
day) and ``24/7``. Rules with a year or month and rules that cannot be read are left
out; a later rule replaces an earlier one's days. Intervals past midnight end at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import D, bound, col
from .text import clock_of

DAYS = ("Su", "Mo", "Tu", "We", "Th", "Fr", "Sa")
_DAY_LIST = r"^([A-Z][a-z](?:[-,][A-Z][a-z])*)\s+(.+)$"
_MONTHS = r"\d{4}|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_INTERVALS = "array<struct<start_min:int,end_min:int>>"


def _trimmed_parts(c: Column, by: str) -> Column:
    return F.filter(F.transform(F.split(c, by), lambda s: F.trim(s)), lambda s: s != "")


def _day_number(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, d in enumerate(DAYS):
        out = F.when(name == d, k).otherwise(out)
    return out


def _days(spec: Column) -> Column:
    """array<int> of the days of a list; a range that runs over the week's end wraps."""
    def one(token: Column) -> Column:
        first, last = _day_number(F.substring(token, 1, 2)), _day_number(F.substring(token, 4, 2))
        span = F.sequence(F.lit(0), F.pmod(last - first, F.lit(7)))
        wide = F.when(first.isNotNull() & last.isNotNull(), F.transform(span, lambda k: (first + k) % 7))
        return F.when(F.length(token) == 5, wide).otherwise(F.when(first.isNotNull(), F.array(first)))

    each = F.transform(_trimmed_parts(spec, ","), lambda t: F.coalesce(one(t), F.array().cast("array<int>")))
    return F.array_distinct(F.flatten(each))


def _minute(c: Column) -> Column:
    h, m = F.split(c, ":")[0].try_cast("int"), F.split(c, ":")[1].try_cast("int")
    return F.when((h <= 28) & (m <= 59), h * 60 + m)


def _intervals(spec: Column) -> Column:
    """The intervals of a day's times; null where they cannot be read."""
    ranges = F.filter(_trimmed_parts(spec, ","), lambda r: ~r.isin("off", "closed"))
    form = r"^\d{1,2}:\d{2}-\d{1,2}:\d{2}$"

    def one(r: Column) -> Column:
        start, end = _minute(F.split(r, "-")[0]), _minute(F.split(r, "-")[1])
        return F.struct(start.alias("start_min"), F.when(end <= start, 1440).otherwise(end).alias("end_min"))

    whole = lambda i: i["start_min"].isNotNull() & i["end_min"].isNotNull()
    read = F.transform(ranges, lambda r: F.when(r.rlike(form), one(r)))
    return bound(read, lambda x: F.when(F.forall(x, lambda i: i.isNotNull() & whole(i)), x))


def parse_week(spec: D) -> Column:
    """array<struct<day, intervals>> from Sunday (0), seven days; null where nothing can be read.

    intervals is null for a day that is closed or not mentioned.
    """
    c = F.trim(col(spec))
    every = F.array(*(F.lit(k) for k in range(7)))

    def rule(r: Column) -> Column:
        listed = r.rlike(_DAY_LIST)
        days = F.when(listed, _days(F.regexp_extract(r, _DAY_LIST, 1))).otherwise(every)
        times = F.when(listed, F.trim(F.regexp_extract(r, _DAY_LIST, 2))).otherwise(r)
        shut = times.isin("off", "closed")
        return F.struct(days.alias("days"), F.when(~shut, _intervals(times)).alias("intervals"), shut.alias("shut"))

    rules = F.transform(F.filter(_trimmed_parts(c, ";"), lambda r: ~r.rlike(_MONTHS)), rule)
    readable = F.filter(rules, lambda r: (F.size(r["days"]) > 0) & (r["shut"] | r["intervals"].isNotNull()))

    def named(read: Column) -> Column:
        with_none = F.concat(F.array(F.struct(every.alias("days"), F.lit(None).cast(_INTERVALS).alias("intervals"), F.lit(True).alias("shut"))), read)
        return F.when(F.size(read) > 0, bound(with_none, lambda r: F.transform(every, lambda k: day_of(r, k))))

    def day_of(read: Column, k: Column) -> Column:
        last = F.element_at(F.filter(read, lambda r: F.array_contains(r["days"], k)), -1)
        return F.struct(k.alias("day"), last["intervals"].alias("intervals"))

    always = F.array(F.struct(F.lit(0).alias("start_min"), F.lit(1440).alias("end_min")))
    whole = F.transform(every, lambda k: F.struct(k.alias("day"), always.alias("intervals")))
    return F.when(c == "24/7", whole).when(c != "", bound(readable, named))


def week_rows(week: D) -> Column:
    """array<struct<day, intervals>>: a week (parse_week) from Monday, of neighbouring days with equal hours the first."""
    def first(days: Column) -> Column:
        return F.filter(days, lambda d, i: (i == 0) | ~F.get(days, i - 1)["intervals"].eqNullSafe(d["intervals"]))

    return bound(F.concat(F.slice(col(week), 2, 6), F.slice(col(week), 1, 1)), first)


def with_weeks(df: DataFrame, spec: str, name: str = "week") -> DataFrame:
    """df with parse_week() of its specs, each distinct one of which is parsed once.

    Venues share their specs, so the parsed side is far smaller than df; Spark broadcasts it
    where its measured size allows. Rows without a spec have no week.
    """
    key = "__" + spec
    parsed = df.select(F.col(spec).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(name, parse_week(key))
    return df.join(parsed, df[spec] == parsed[key], "left").drop(key)


def status(week: D, day: D, minute: D) -> Column:
    """struct<knowable, is_open, label> on a day (0 = Sunday) at a minute since midnight.

    Labels: ``open HH:MM-HH:MM``, ``open 24h``, ``closed, opens HH:MM``, ``closed, hours ...``,
    ``closed, opens +N HH:MM`` (N days ahead) and ``closed``.
    """
    w, d, m = col(week), col(day), col(minute)
    today = F.element_at(w, d + 1)["intervals"]
    always = F.forall(w, lambda x: (F.size(x["intervals"]) == 1) & (x["intervals"][0]["start_min"] == 0) & (x["intervals"][0]["end_min"] == 1440))
    now = F.exists(today, lambda i: (i["start_min"] <= m) & (m < i["end_min"]))
    later = F.filter(today, lambda i: i["start_min"] > m)
    text = F.array_join(F.transform(today, lambda i: F.concat(clock_of(i["start_min"]), F.lit("-"), clock_of(i["end_min"]))), ", ")
    ahead = F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.struct(k.alias("k"), F.element_at(w, (d + k) % 7 + 1)["intervals"].alias("i"))),
        lambda x: F.size(x["i"]) > 0,
    )

    def next_day(x: Column) -> Column:
        opens = F.concat(F.lit("closed, opens +"), x["k"].cast("string"), F.lit(" "), clock_of(F.get(x["i"], F.lit(0))["start_min"]))
        return F.when(x.isNotNull(), opens).otherwise("closed")

    label = (
        F.when(always, "open 24h")
        .when(today.isNull(), bound(F.get(ahead, F.lit(0)), next_day))
        .when(now, F.concat(F.lit("open "), text))
        .when(F.size(later) > 0, F.concat(F.lit("closed, opens "), clock_of(F.get(later, F.lit(0))["start_min"])))
        .otherwise(F.concat(F.lit("closed, hours "), text))
    )
    known = w.isNotNull()
    return F.struct(known.alias("knowable"), F.coalesce(always | now, F.lit(False)).alias("is_open"), F.when(known, label).otherwise("").alias("label"))
