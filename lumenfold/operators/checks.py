"""Data-quality checks that report problems as rows, and merges of stored sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..sources import sinks


def labelled(df: DataFrame, rules: dict[str, Column], label: str = "problem") -> DataFrame:
    """df with a row for each rule that a row breaks: label is the rule's name. Null conditions count as kept."""
    broken = F.array(*(F.when(c, F.lit(name)) for name, c in rules.items()))
    return df.withColumn(label, F.explode(F.filter(broken, lambda x: x.isNotNull())))


def large_enough(width: str, depth: str, height: str, side: float = 1.0, base: float = 4.0) -> Column:
    """Whether an obstacle is worth keeping: each side and the ground that it covers (in metres and square metres)."""
    w, d = F.col(width), F.col(depth)
    return (w >= side) & (d >= side) & (F.col(height) >= side) & (w * d >= base)


def without_elevation(points: DataFrame, key: str, outdoor: str, elevation: str) -> DataFrame:
    """Keys that have outdoor points, none of which has an elevation: nothing can be computed for them."""
    seen = points.groupBy(key).agg(F.count_if(F.col(outdoor)).alias("__n"), F.count_if(F.col(outdoor) & F.col(elevation).isNotNull()).alias("__known"))
    return seen.where("__n > 0 AND __known = 0").select(key, F.col("__n").alias("points"))


def dense_index(points: DataFrame, key: str, index: str) -> DataFrame:
    """key, n, top, distinct, ok: whether each key's index runs from 0 without gaps or repeats."""
    out = points.groupBy(key).agg(F.count("*").alias("n"), F.max(index).alias("top"), F.countDistinct(index).alias("distinct"))
    return out.withColumn("ok", (F.col("top") + 1 == F.col("n")) & (F.col("distinct") == F.col("n")))


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """only_a, only_b, both: how many distinct keys of two runs have no counterpart."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    j = x.join(y, key, "full")
    return j.agg(
        F.count_if(F.col("__b").isNull()).alias("only_a"), F.count_if(F.col("__a").isNull()).alias("only_b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both")
    )


def merged_manifest(old: DataFrame, new: DataFrame, keys: list[str], ids: str, failed: str) -> DataFrame:
    """Run manifests united by key: sorted ids of both, failures that did not succeed since, complete if none is left."""
    both = old.unionByName(new).groupBy(*keys).agg(F.flatten(F.collect_list(ids)).alias(ids), F.flatten(F.collect_list(failed)).alias(failed))
    done = F.array_sort(F.array_distinct(ids))
    left = F.array_sort(F.array_except(F.array_distinct(failed), F.col(ids)))
    return both.select(*keys, done.alias(ids), left.alias(failed), (F.size(left) == 0).alias("complete"))


#: Counters of a core that are busy time; the other one is idle. (Fixed values.)
BUSY = ("user", "nice", "sys", "irq")


def busy_shares(snapshots: DataFrame) -> DataFrame:
    """at, cores, average, highest: how busy the cores were, in percent, between each snapshot and the one before it.

    snapshots: at, core and the counters of BUSY and idle, which only grow. A core's share is busy / (busy + idle) of what its counters grew by, 0 where they
    did not grow or went back, to one digit; the average is that of those shares. A core's first snapshot has none before it and takes no part, nor has one with a null.
    """
    whole = snapshots.dropna(subset=["at", "core", *BUSY, "idle"])
    before = Window.partitionBy("core").orderBy("at")
    grew = lambda c: F.col(c) - F.lag(c).over(before)
    deltas = whole.select("at", "core", sum((grew(c) for c in BUSY[1:]), grew(BUSY[0])).alias("busy"), grew("idle").alias("rest")).where("busy is not null")
    total = F.col("busy") + F.col("rest")
    share = half_up(F.when(total > 0, F.col("busy") / total * 100).otherwise(0.0), 1)
    n, tenths = F.count("*"), F.sum(F.round(F.col("share") * 10).cast("bigint"))  # summed as whole numbers, so that the order of rows does not tell
    average = F.floor((2 * tenths + n) / (2 * n)) / 10
    return deltas.withColumn("share", share).groupBy("at").agg(n.alias("cores"), average.alias("average"), F.max("share").alias("highest"))


def outline_edges(tiles: DataFrame, *keys: str) -> DataFrame:
    """tiles (i, j) to the unit edges on their outline: those that belong to one tile only. x1, y1, x2, y2 and the tile; keys keep grids apart."""
    side = lambda a, b, c, d: F.struct((F.col("i") + a).alias("x1"), (F.col("j") + b).alias("y1"), (F.col("i") + c).alias("x2"), (F.col("j") + d).alias("y2"))
    sides = F.array(side(0, 0, 1, 0), side(0, 1, 1, 1), side(0, 0, 0, 1), side(1, 0, 1, 1))
    edges = tiles.select(*keys, "i", "j").distinct().select(*keys, "i", "j", F.explode(sides).alias("e")).select(*keys, "i", "j", "e.*")
    return edges.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.count("*").alias("n"), F.min("i").alias("i"), F.min("j").alias("j")).where("n = 1").drop("n")


def components(tiles: DataFrame) -> DataFrame:
    """tiles (i, j) with component: the smallest (i, j) reachable over shared sides, as a struct.

    Each round gives all tiles of a label the smallest label beside any of them, and follows that label's own. Every label that is not the
    least around it goes in a round, so rounds grow with the logarithm of a component's extent; they end when none goes.
    Results are written to the shared folder (cut()).
    """
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    own = tiles.select("i", "j").distinct().withColumn("c", F.struct("i", "j"))
    beside = own.select("c", F.explode(steps).alias("s")).select("c", (F.col("c.i") + F.col("s.a")).alias("i"), (F.col("c.j") + F.col("s.b")).alias("j"))
    sides = cut(beside.join(own.select("i", "j", F.col("c").alias("o")), ["i", "j"]).select("c", "o"))
    now = cut(own)
    while not sides.isEmpty():
        low = cut(sides.groupBy("c").agg(F.min("o").alias("o")).select("c", F.least("c", "o").alias("to")))
        went, on = low, low.select(F.col("c").alias("to"), F.col("to").alias("further"))
        for _ in range(5):
            went = went.join(on, "to").select("c", F.col("further").alias("to"))
        went = cut(went.where("c <> to").withColumnRenamed("to", "further"))
        told = lambda df, c: df.join(went.withColumnsRenamed({"c": c, "further": "__to"}), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")  # noqa: B023, E731
        now, sides = cut(told(now, "c")), cut(told(told(sides, "c"), "o").where("c <> o").distinct())
    return now.withColumnRenamed("c", "component")


def filled(tiles: DataFrame, passes: int = 20, neighbours: int = 3) -> DataFrame:
    """tiles (i, j) with holes filled: empty cells with so many of four neighbours join, until none does."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    now = tiles.select("i", "j").distinct()
    for _ in range(passes):
        around = now.select(F.explode(F.transform(steps, lambda s: F.struct((F.col("i") + s["a"]).alias("i"), (F.col("j") + s["b"]).alias("j")))).alias("p")).select("p.*")
        new = cut(around.groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") >= neighbours).drop("n").join(now, ["i", "j"], "left_anti"))
        if new.isEmpty():
            break
        now = cut(now.unionByName(new))
    return now


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: written once, it cuts lineage.

    A checkpoint would keep the size that the plan before it was estimated at, and joins multiply estimates: in a loop the number's digits
    grow by a factor each round, until the driver has no room for them.
    """
    path = sinks.scratch_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
