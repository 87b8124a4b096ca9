"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches sent to Python hold at most this many rows and about this many bytes,
#: so that long texts cannot fill a worker's memory.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20

#: A set of ids is broadcast only if it has at most this many members (8 bytes each).
BROADCAST_IDS = 1_000_000

#: link_buckets() ends its rounds after so many, when one leaves more than this share of the open members,
#: or when members have no more than about so many others in their buckets.
ROUNDS, ENOUGH, FEW = 6, 0.7, 16
#: Members of a bucket that a part of it holds, and members of a tile where all pairs are tried.
PART, TILE = 5000, 500
#: A key with more than one in so many of all rows is heavy.
HEAVY_SHARE = 10_000

#: ASCII upper case to lower case, nothing else.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: The same, and every ASCII byte that is no letter or digit becomes a space.
ASCII_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session unless it already asks for smaller ones."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        try:
            now = int("".join(c for c in str(spark.conf.get(key, "0")) if c.isdigit()) or 0)
        except Exception:  # the setting does not exist in this version
            continue
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, and at their end free memory goes back to the system: workers wait for their next task."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser (Steele, Lea and Flood 2014): every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _process_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lumenfold-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


class Scratch:
    """Intermediate tables as Parquet in the folder that the whole cluster shares.

    They cut lineage and survive lost executors. The folder is the session's
    ``spark.checkpoint.dir``. Only where that is unset another is taken: in local mode
    (one process) a temporary one that goes with it, else one under the warehouse.
    Results read from these tables, so whoever runs the session empties the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            base = _process_folder()
        base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        self.spark, self.base, self.n = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        delete(self.spark, df.scratch_path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of tables that are saved by now: it does when the driver collects its garbage, which
        may be long after they have filled the disks."""
        self.spark.sparkContext._jvm.System.gc()


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that is not among those taken, in any case."""
    low = {c.lower() for c in taken}
    out = f"__{name.strip('_')}"
    while out.lower() in low:
        out += "_"
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def only_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows of df whose id is in ids (one saved column of the same name, distinct).

    Up to BROADCAST_IDS ids are broadcast, so that df's texts are not shuffled
    for the test; more are joined by a shuffle.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_semi")


#: Characters of a text that are learned from. A longer one gives so many in TRAIN_PIECES even pieces over its whole
#: length, so that a sample of n rows has n times so many at most.
TRAIN_CHARS, TRAIN_PIECES = 100_000, 16


def bounded(text: Column, chars: int = TRAIN_CHARS, pieces: int = TRAIN_PIECES) -> Column:
    """text, or of one of more than ``chars`` characters pieces of ``chars / pieces`` each, evenly spread from its start to its end, joined by spaces."""
    each = max(1, chars // pieces)
    begin = lambda i: (F.floor(i * (F.length(text) - each) / max(1, pieces - 1)) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, begin(i), F.lit(each)))
    return F.when(text.isNull() | (F.length(text) <= chars), text).otherwise(F.array_join(cut, " "))


def lowest(rows: DataFrame, hashed: Column, n: int, total: int) -> DataFrame:
    """The rows whose hash is among about the n lowest of total: n or more of them, but for a chance of one in a million.

    Only a share of the rows is passed on, so that choosing n of them exactly needs no sort of all.
    """
    share = min(1.0, (n + 5 * n**0.5 + 25) / max(1, total))
    return rows if share == 1 else rows.where(F.pmod(hashed, F.lit(1 << 31)) < int(share * (1 << 31)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, label: str, chars: int | None = None) -> list[tuple[str, int, float]]:
    """At most ``rows`` (text, label, weight) for the driver, in a fixed order.

    labels (doc_id, label): other values than 0 and 1 and null ids are not used, nor are ids
    that have both labels, ids without a document, documents without text, and, where it is given, those of more than ``chars``
    characters. All others can be chosen; long texts come as bounded() has them. Each class gives half, chosen by a hash of doc_id; where one has fewer, the
    other fills up. Weights restore the classes' true shares (their sum is the number of rows), so
    that scores mean the same whether or not the bound is reached. A doc_id with several texts
    counts with the smallest of them. Ids are chosen first, among those that have a text (a join of
    ids alone), and are few enough to be broadcast, so texts are read once and only chosen ones are grouped.
    """
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    texts = texts if chars is None else texts.where(F.length("text") <= chars)
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    usable = usable.agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("__z")).where("y = __z").select("doc_id", "y")
    usable = usable.join(texts.select("doc_id"), "doc_id", "left_semi")
    n = {0: 0, 1: 0} | {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    few = min(n, key=n.get)
    take = {few: min(n[few], rows // 2)}
    take[1 - few] = min(n[1 - few], rows - take[few])
    h = F.xxhash64("doc_id", F.lit(3))
    ids = [lowest(usable.where(F.col("y") == k), h, take[k], n[k]).orderBy(h, "doc_id").limit(take[k]) for k in (0, 1)]
    texts = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").withColumn("text", bounded(F.col("text"))).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = sorted((r.doc_id, r.text, r.y) for r in texts.toLocalIterator())
    held = {k: sum(y == k for _, _, y in got) for k in (0, 1)}
    weight = {k: n[k] / max(1, n[0] + n[1]) * len(got) / max(1, held[k]) for k in (0, 1)}
    if not held[0] or not held[1]:
        weight = {0: 1.0, 1: 1.0}
    return [(text, y, weight[y]) for _, text, y in got]


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component) of every node in edges (a, b): the component is its smallest id.

    Alternates large-star and small-star steps, so the rounds grow with the
    logarithm of the number of nodes, not with the length of chains, and each
    step is a grouped minimum with map-side combining plus one equi-join.
    """
    now = scratch.save(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = scratch.save(small, "edges")
        scratch.drop(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """A row count and an order-free hash of the edges: two numbers, whatever their number."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first()
    return tuple(row)


def link_buckets(
    scratch: Scratch,
    keys: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    nodes: DataFrame | None = None,
    fits: Callable[[Carried, Carried], Column] | None = None,
    distance: Callable[[Carried, Carried], Column] | None = None,
    few: int = 2,
) -> DataFrame:
    """Edges (a, b) that connect all ids that share a bucket and pass verification.

    keys: (key, id), which is evaluated twice. verify takes candidate pairs (a, b), a < b,
    and returns those that are linked. nodes (id and what members carry), fits and distance
    may serve to prune: pairs that do not fit are never made, and in the rounds each member
    tries only the nearest of its candidates.

    Buckets of two give their pair at once, from a count that is combined before the
    shuffle; those of at most ``few`` members give their pairs that fit. No larger bucket is
    expanded into all its pairs at once. In each round, every
    member is tried against one member of its bucket (first the most central one, which
    shares most buckets with others; later one by lot), and the components of all links so
    far are found. Links inside a component could not change it, so only buckets that hold
    several components go on. When rounds no longer join much, all pairs of different
    components that share a bucket are tried, tile by tile, so the components are those of
    all links. A large bucket is dealt over parts of about PART members throughout.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    sizes = scratch.save(sizes.where("n > 1 and a <> b"), "sizes")
    couples = sizes.where("n = 2").select("a", "b").distinct()
    wide = sizes.where("n > 2").select("key", F.col("n").cast("int").alias("n"))
    shared = keys.join(F.broadcast(wide) if wide.count() <= BROADCAST_IDS else wide, "key")
    shared = scratch.save(shared.select("key", "id", "n"), "shared")
    if fits is not None:
        side = lambda name: nodes.select(F.struct("*").alias(name))
        couples = couples.join(side("x"), F.col("a") == F.col("x.id")).join(side("y"), F.col("b") == F.col("y.id"))
        couples = couples.where(fits(Carried("x"), Carried("y"))).select("a", "b")
    carried = [c for c in (nodes.columns if nodes is not None else []) if c != "id"]
    whole = shared if nodes is None else shared.join(nodes, "id")
    if few > 2:
        small = whole.where(F.col("n") <= few)
        x, y = small.alias("x"), small.alias("y")
        both = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))
        pairs = x.join(y, both if fits is None else both & fits(Carried("x"), Carried("y")))
        couples = couples.unionByName(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))).distinct()
        whole, shared = whole.where(F.col("n") > few), shared.where(F.col("n") > few)
    open_ = scratch.save(whole.join(shared.groupBy("id").agg(F.sum("n").alias("degree")), "id").withColumn("c", F.col("id")), "buckets")
    left = edges = None
    for turn in range(ROUNDS):
        order = F.struct("degree", -F.col("id")) if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)), "id")
        lead = open_.groupBy("key").agg(F.max_by(F.struct("id", "c", *carried), order).alias("x"), F.max("n").alias("n"))
        lead = lead.select("key", "x", F.explode(F.sequence(F.lit(0), _parts("n") - 1)).alias("part"))
        fit = F.col("y.c") != F.col("x.c")
        pairs = _dealt(open_).alias("y").join(lead, ["key", "part"]).where(fit if fits is None else fit & fits(Carried("x"), Carried("y")))
        pair = (F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        if distance is None:
            stars = pairs.select(*pair)
        else:
            near = F.min(F.struct(distance(Carried("x"), Carried("y")).alias("d"), *pair)).alias("m")
            stars = pairs.groupBy(F.col("y.id")).agg(near).select("m.a", "m.b")
        tried = scratch.save((stars.unionByName(couples) if turn == 0 else stars).distinct(), "candidates")
        found = verify(tried)
        edges = scratch.save(found if edges is None else edges.unionByName(found), "links")
        scratch.drop(tried)
        comp = scratch.save(connected_components(scratch, edges), "components")
        named = open_.drop("c").join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").cast("int").alias("now"), F.max("n").alias("n"))
        mixed = mixed.where("lo <> hi").select("key", "now", F.explode(F.sequence(F.lit(0), _parts("n") - 1)).alias("part"))
        after = _dealt(named).join(mixed, ["key", "part"]).withColumn("n", F.col("now")).drop("now", "part")
        after = scratch.save(after.select(*open_.columns), "open")
        scratch.drop(open_)
        scratch.drop(comp)
        open_ = after
        size = open_.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("pairs")).first()
        before, left = left, size.n or 0
        if not left:
            return edges
        if size.pairs <= FEW * left or (before is not None and left > ENOUGH * before):
            break
    x, y = _tiled(open_).alias("x"), _tiled(open_).alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & (F.col("x.c") < F.col("y.c"))
    apart = apart & ((F.col("x.tile") != F.col("y.tile")) | (F.col("x.lo") == F.col("x.hi")))
    pairs = x.join(y, apart if fits is None else apart & fits(Carried("x"), Carried("y")))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    return edges.unionByName(scratch.save(verify(scratch.save(pairs, "candidates")), "more_links"))


def _parts(n: str) -> Column:
    return F.ceil(F.col(n) / PART).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with the part of their bucket, 0 in those of at most PART members."""
    return rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(29)), _parts("n")).cast("int"))


def _tiled(rows: DataFrame) -> DataFrame:
    """rows once for each pair (lo, hi) of tiles of their bucket with their own tile in it.

    Two members of different tiles meet in one such pair, those of one tile where lo = hi.
    """
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id", F.lit(31)), tiles).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return rows.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other")).drop("other")


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows (saved) joined with keyed (saved, distinct by ``on``), whose n says how many of the ``total`` rows a key has.

    Up to BROADCAST_IDS keys are broadcast. Of more, the heavy ones are: those of over a
    10,000th of all rows, so at most 10,000. Without them, no key has enough rows to fill a task.
    """
    if keyed.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(keyed), on).drop("n")
    heavy = F.broadcast(keyed.where(F.col("n") > total // HEAVY_SHARE))
    light = rows.join(heavy.select(*on), on, "left_anti").join(keyed.where(F.col("n") <= total // HEAVY_SHARE), on)
    return rows.join(heavy, on).unionByName(light).drop("n")


class Carried:
    """Columns of one side of a pair: ``side("n")``."""

    def __init__(self, side: str):
        self.side = side

    def __call__(self, name: str) -> Column:
        return F.col(f"{self.side}.{name}")
