"""Hard negatives from vantage-point trees over norm-augmented vectors.

Each row's vector x gets one more component, sqrt(M^2 - |x|^2), where M is the longest row's
norm; an anchor a gets 0. Then |a' - x'|^2 = |a|^2 + M^2 - 2 a.x: the highest inner products are the
nearest rows, and a window of scores is an annulus of distances (Bachrach et al. 2014). A
tree over a bounded sample deals all rows into cells; each block of a cell has a tree of its
own. A search goes through leaves from the annulus's inner edge outwards and ends when no
leaf left can hold a better row, first in each anchor's best cell, then, with the bound found there, in
the other cells that can still matter.

Scores are whole numbers and exact; distances only decide what is passed over, with a margin for rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lowest, prepare

#: Rows that the upper tree is made from, rows that a cell should hold, and its most levels (so at most 2^10 cells).
SAMPLE, CELL_ROWS, LEVELS = 8192, 2048, 10
#: Rows of a block, of a leaf of its tree, and queries that meet a block at once.
BLOCK, LEAF, CHUNK = 16_384, 128, 4096
#: Share of a distance that rounding may be off by.
MARGIN = 1e-9

_QUERY = "q long, skip long, label long, v array<int>, n2 long, lo long, hi long, cell int"
_FOUND = "q long, id long, score long"
_BLOCK = "cell int, part int, ids array<long>, labels array<long>, rows binary, starts array<int>, vantage array<int>, path binary, near binary, far binary"


def augmented(x: np.ndarray, longest2: float) -> np.ndarray:
    """The rows of x with the component that gives each the norm sqrt(longest2)."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, longest2 - (x * x).sum(1)))])


@dataclass
class Tree:
    """vantage: row numbers of the vantage points; cut and child: by inner node (child < 0: leaf ~child).

    order: row numbers leaf by leaf; starts: where leaves begin in it. path: by leaf, the inner nodes above it (-1:
    none); near and far: least and greatest distance of the leaf's rows from their vantage points.
    """

    vantage: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    order: np.ndarray
    starts: np.ndarray
    path: np.ndarray
    near: np.ndarray
    far: np.ndarray


def _vantage(points: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray]:
    """Of five rows the one whose distances spread most, and all rows' distances from it."""
    step = max(1, len(rows) // 256)
    some = points[rows[::step]]
    pick = max(rows[:: max(1, len(rows) // 5)][:5].tolist(), key=lambda r: float(np.linalg.norm(some - points[r], axis=1).var()))
    return pick, np.linalg.norm(points[rows] - points[pick], axis=1)


def build(points: np.ndarray, leaf: int, levels: int = 64, halve: bool = True) -> Tree:
    """A tree over augmented points with leaves of at most ``leaf`` rows, or on ``levels`` levels.

    Rows that are all equally far from their vantage point cannot be told by distance: with ``halve`` they are
    cut into halves, so that any leaf is small, else they stay together, so that routes are defined.
    """
    vantage, cut, child, leaves = [], [], [], []
    todo = [(np.arange(len(points)), [], None)]
    while todo:
        rows, above, parent = todo.pop()
        at = None
        if len(rows) > leaf and len(above) < levels:
            pick, d = _vantage(points, rows)
            mid = float(np.median(d))
            left = d <= mid
            if left.all():
                mid = float(np.nextafter(mid, -1.0))
                left = d <= mid
            if left.any() or halve:
                if not left.any():
                    left = np.arange(len(rows)) < len(rows) // 2
                at = len(vantage)
                vantage.append(pick)
                cut.append(mid)
                child.append([0, 0])
                for k, side in enumerate((left, ~left)):
                    todo.append((rows[side], [(n, dd[side]) for n, dd in above] + [(at, d[side])], (at, k)))
        if at is None:
            at = ~len(leaves)
            leaves.append((rows, above))
        if parent is not None:
            child[parent[0]][parent[1]] = at
    depth = max(1, *(len(above) for _, above in leaves))
    path, near, far = np.full((len(leaves), depth), -1, np.int32), np.zeros((len(leaves), depth)), np.zeros((len(leaves), depth))
    for k, (rows, above) in enumerate(leaves):
        for level, (n, d) in enumerate(above):
            if len(rows):
                path[k, level], near[k, level], far[k, level] = n, d.min(), d.max()
    sizes = [len(rows) for rows, _ in leaves]
    return Tree(
        np.array(vantage, np.int32), np.array(cut), np.array(child, np.int32).reshape(-1, 2), np.concatenate([rows for rows, _ in leaves]).astype(np.int64),
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), path, near, far,
    )


def route(x: np.ndarray, vantage: np.ndarray, cut: np.ndarray, child: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each augmented row of x and its distances from the vantage points above it (nan where there are fewer)."""
    at, d = np.full(len(x), 0 if len(cut) else -1), np.full((len(x), levels), np.nan)
    for level in range(levels):
        for node in np.unique(at[at >= 0]).tolist():
            rows = np.flatnonzero(at == node)
            d[rows, level] = np.linalg.norm(x[rows] - vantage[node], axis=1)
            at[rows] = child[node][(d[rows, level] > cut[node]).astype(int)]
    return ~at, d


def bounds(distance: np.ndarray, path: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance that a leaf's rows can have from each query, by its distances from the vantage points."""
    low, high = np.zeros((len(distance), len(path))), np.full((len(distance), len(path)), np.inf)
    for level in range(path.shape[1]):
        on = np.flatnonzero(path[:, level] >= 0)
        d = distance[:, path[on, level]]
        low[:, on] = np.maximum(low[:, on], np.maximum(d - far[on, level], near[on, level] - d))
        high[:, on] = np.minimum(high[:, on], d + far[on, level])
    return low, high


class Annuli:
    """The queries of a batch: vectors, and the annulus of distances that their score windows are (bounds may be None)."""

    def __init__(self, v: np.ndarray, lo: list, hi: list, longest2: int):
        self.v, self.base = v, (v.astype(np.float64) ** 2).sum(1) + longest2
        self.lo = np.array([-np.inf if x is None else x for x in lo], np.float64)
        self.hi = np.array([np.inf if x is None else x for x in hi], np.float64)
        self.slack = MARGIN * (1 + np.sqrt(4.0 * self.base))
        self.inner, self.outer = self.distance(self.hi), self.distance(self.lo)

    def distance(self, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.base - 2 * score))

    def leaves(self, points: np.ndarray, path: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """How near to the inner edge, from outside, each leaf may come; infinite where the annulus misses it. points: vantage points."""
        if not len(points):
            return np.broadcast_to(self.inner[:, None], (len(self.v), len(path))).copy()
        d = np.sqrt(np.maximum(0.0, self.base[:, None] - 2 * (self.v.astype(np.float64) @ points.astype(np.float64).T)))
        low, high = bounds(d, path, near, far)
        key = np.maximum(low, self.inner[:, None])
        key[(high < (self.inner - self.slack)[:, None]) | (low > (self.outer + self.slack)[:, None])] = np.inf
        return key


def search(rows: np.ndarray, kinds: np.ndarray, nth: np.ndarray, own: np.ndarray, tree: Tree, asked: Annuli, label: np.ndarray, alien: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The best k rows of a block for each query: (row numbers, -1 where there are fewer; scores).

    rows in leaf order, with their labels (kinds), order among equal scores (nth, distinct) and ids (own);
    label and alien: the query's label and the id that it may not meet. Rounds: every query that is not
    done reads its next leaf, nearest first; leaves multiply with all their queries at once.
    """
    m = len(asked.v)
    kind = np.float32 if np.max(asked.base, initial=0) < 1 << 24 else np.float64  # sums are below |a||x| <= base, so exact
    rows, v = rows.astype(kind), asked.v.astype(kind)
    key = asked.leaves(rows[tree.vantage], tree.path, tree.near, tree.far)
    turn = np.argsort(key, axis=1, kind="stable")
    best, score, order = np.full((m, k), -1, np.int64), np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max)
    live = np.arange(m)
    for at in range(turn.shape[1]):
        leaf = turn[live, at]
        ends = np.where(np.isinf(score[live, -1]), asked.outer[live], asked.distance(score[:, -1])[live])
        going = np.isfinite(key[live, leaf]) & (key[live, leaf] <= ends + asked.slack[live])
        live, leaf = live[going], leaf[going]
        if not len(live):
            break
        by = np.argsort(leaf, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            q, one = live[group], slice(tree.starts[leaf[group[0]]], tree.starts[leaf[group[0]] + 1])
            s = (v[q] @ rows[one].T).astype(np.float64)
            fits = ((label[q, None] == kinds[None, one]) == same) & (s >= np.maximum(asked.lo[q], score[q, -1])[:, None]) & (s <= asked.hi[q][:, None])
            fits &= own[None, one] != alien[q, None]
            hit = np.flatnonzero(fits.any(1))
            if len(hit):
                q = q[hit]
                new = np.broadcast_to(np.arange(one.start, one.stop), (len(hit), one.stop - one.start))
                all_best = np.hstack([best[q], np.where(fits[hit], new, -1)])
                all_score = np.hstack([score[q], np.where(fits[hit], s[hit], -np.inf)])
                all_order = np.hstack([order[q], np.where(fits[hit], nth[new], np.iinfo(np.int64).max)])
                first = np.lexsort((all_order, -all_score), axis=1)[:, :k]
                best[q], score[q], order[q] = (np.take_along_axis(x, first, 1) for x in (all_best, all_score, all_order))
    return best, score


#: Stands for a null id inside blocks: no row or anchor with an id of its own has it, as blocks keep ids apart by it.
_NO_ID = np.iinfo(np.int64).min


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Index:
    """The indexed rows: cells of the upper tree with what bounds them, and blocks (a saved table)."""

    spark: SparkSession
    scratch: Scratch
    blocks: DataFrame
    parts: dict[int, int]
    width: int
    longest2: int
    vantage: np.ndarray
    path: np.ndarray
    near: np.ndarray
    far: np.ndarray
    cells: np.ndarray

    @classmethod
    def over(cls, rows: DataFrame, width: int, longest2: int, total: int, scratch: Scratch, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> Index:
        """rows (saved): id, label, v (``width`` whole numbers each), n2."""
        spark = rows.sparkSession
        prepare(spark)
        h = F.xxhash64("v", "id")
        some = lowest(rows, h, min(SAMPLE, total), total).orderBy(h).limit(SAMPLE).select("v").toArrow()
        sample = augmented(_matrix(some.column("v"), width), longest2)
        levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, total) / cell_rows)))))
        upper = build(sample, 1, levels, halve=False)
        vantage, cut, child, depth = sample[upper.vantage], upper.cut, upper.child, upper.path.shape[1]

        def deal(batches):
            for batch in batches:
                cell, d = route(augmented(_matrix(batch.column(2), width), longest2), vantage, cut, child, depth)
                told = pa.array(d.ravel(), from_pandas=False)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.ListArray.from_arrays(np.arange(0, len(told) + 1, depth, dtype=np.int32), told)],
                    ["id", "label", "v", "cell", "d"],
                )

        dealt = rows.select("id", "label", "v").mapInArrow(deal, "id long, label long, v array<int>, cell int, d array<double>")
        dealt = scratch.save(dealt.withColumn("n", F.monotonically_increasing_id()), "dealt")
        edge = [f(F.col("d")[k]).alias(f"{n}{k}") for k in range(depth) for n, f in (("near", F.min), ("far", F.max))]
        cells = sorted(dealt.groupBy("cell").agg(F.count("*").alias("n"), *edge).collect(), key=lambda r: r.cell)
        parts = {r.cell: -(-r.n // block) for r in cells}
        sizes = spark.createDataFrame(list(parts.items()), "cell int, parts int")
        part = F.pmod(F.col("n"), F.col("parts")).cast("int")  # not by a hash: copies of one row would all go to one block
        grouped = dealt.drop("d").join(F.broadcast(sizes), "cell").withColumn("part", part).drop("n", "parts").groupBy("cell", "part")
        blocks = scratch.save(grouped.applyInArrow(_packer(width, longest2), _BLOCK), "blocks")
        of = [r.cell for r in cells]
        return cls(
            spark, scratch, blocks, parts, width, longest2, vantage[:, :-1], upper.path[of],
            np.array([[r[f"near{k}"] for k in range(depth)] for r in cells]).reshape(-1, depth), np.array([[r[f"far{k}"] for k in range(depth)] for r in cells]).reshape(-1, depth),
            np.array(of, np.int32),
        )

    def visits(self, queries: DataFrame, first: bool) -> DataFrame:
        """queries once for each cell to be searched: the best one (first), or all others that the window reaches (cell: the first)."""
        width, longest2, vantage, path, near, far, cells = self.width, self.longest2, self.vantage, self.path, self.near, self.far, self.cells

        def choose(batches):
            for batch in batches:
                asked = Annuli(_matrix(batch.column("v"), width), batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), longest2)
                key = asked.leaves(vantage, path, near, far)
                if first:
                    q, at = np.arange(len(key)), key.argmin(1)
                    on = np.isfinite(key[q, at])
                    q, at = q[on], at[on]
                else:
                    q, at = np.nonzero(np.isfinite(key) & (cells[None, :] != batch.column("cell").to_numpy(zero_copy_only=False)[:, None]))
                told = batch.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*told.columns[:-1], pa.array(cells[at])], batch.schema.names)

        return self.scratch.save(queries.mapInArrow(choose, _QUERY), "visits")

    def answers(self, visits: DataFrame, k: int, same: bool) -> DataFrame:
        """(q, id, score): the best k rows of each block that visits (saved) lead to."""
        n = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        deal = self.spark.createDataFrame([(c, self.parts[c], -(-m // CHUNK)) for c, m in n.items()], "cell int, parts int, chunks int")
        asked = visits.join(F.broadcast(deal), "cell").withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int"))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "chunks")
        blocks = self.blocks.join(F.broadcast(deal), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("parts", "chunks")
        on = ("cell", "part", "chunk")
        return blocks.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(_searcher(self.width, self.longest2, k, same), _FOUND)

    def best(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(q, id, score, rank): for each query (q, skip, label, v, n2, lo, hi; saved) its best k rows of the same or another label within [lo, hi]."""
        first = self.visits(queries.withColumn("cell", F.lit(None).cast("int")), True)
        found = self.scratch.save(self.answers(first, k, same), "first")
        least = top(found, k).groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        rest = queries.join(first.select("q", "cell"), "q").join(least, "q", "left").withColumn("lo", F.greatest("lo", "least"))  # greatest() passes over null
        rest = self.visits(rest.select("q", "skip", "label", "v", "n2", "lo", "hi", "cell"), False)
        return top(found.unionByName(self.answers(rest, k, same)), k)


def top(found: DataFrame, k: int) -> DataFrame:
    """The first k of each query with their rank; most rows go before the shuffle."""
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def _packer(width: int, longest2: int):
    def pack(key, table):
        v, ids = _matrix(table.column("v"), width), table.column("id").to_pylist()
        tree = build(augmented(v, longest2), LEAF)
        place = np.empty(len(tree.order), np.int32)
        place[tree.order] = np.arange(len(tree.order))
        row = {
            "cell": key[0].as_py(), "part": key[1].as_py(), "ids": [ids[k] for k in tree.order], "labels": table.column("label").to_numpy()[tree.order],
            "rows": np.ascontiguousarray(v[tree.order], np.int32).tobytes(), "starts": tree.starts, "vantage": place[tree.vantage],
            "path": tree.path.tobytes(), "near": tree.near.tobytes(), "far": tree.far.tobytes(),
        }
        types = {"cell": pa.int32(), "part": pa.int32(), "ids": pa.list_(pa.int64()), "labels": pa.list_(pa.int64()), "starts": pa.list_(pa.int32()), "vantage": pa.list_(pa.int32())}
        return pa.table({c: pa.array([x], types.get(c, pa.binary())) for c, x in row.items()})

    return pack


def _searcher(width: int, longest2: int, k: int, same: bool):
    def answer(blocks, asked):
        none = pa.table({c: pa.array([], pa.int64()) for c in ("q", "id", "score")})
        if not blocks.num_rows or not asked.num_rows:
            return none
        b = {c: blocks.column(c)[0] for c in blocks.column_names}
        ids = b["ids"].values.to_pylist()
        own = np.array([_NO_ID if x is None else x for x in ids], np.int64)
        nth = np.empty(len(ids), np.int64)
        nth[np.lexsort((own, [x is None for x in ids]))] = np.arange(len(ids))
        as_ints = lambda c: b[c].values.to_numpy()
        starts = as_ints("starts")
        shape = (len(starts) - 1, -1)
        tree = Tree(
            as_ints("vantage"), np.empty(0), np.empty(0), np.empty(0), starts, np.frombuffer(b["path"].as_py(), np.int32).reshape(shape),
            np.frombuffer(b["near"].as_py()).reshape(shape), np.frombuffer(b["far"].as_py()).reshape(shape),
        )
        rows = np.frombuffer(b["rows"].as_py(), np.int32).reshape(-1, width)
        told = []
        for batch in asked.to_batches(max_chunksize=CHUNK):
            annuli = Annuli(_matrix(batch.column("v"), width), batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), longest2)
            label, alien = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "skip"))
            best, score = search(rows, as_ints("labels"), nth, own, tree, annuli, label, alien, k, same)
            q, at = np.nonzero(best >= 0)
            told.append(pa.table({
                "q": pa.array(batch.column("q").to_numpy()[q]), "id": pa.array([ids[r] for r in best[q, at].tolist()], pa.int64()),
                "score": pa.array(score[q, at].astype(np.int64)),
            }))
        return pa.concat_tables(told)

    return answer


def whole_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(id, label, v, n2) of vectors (vec_id, label, embedding): v is floor(scale * x) by component, n2 its squared length.

    Rows with a null label, a null vector, or a null or non-finite component are left out. Shorter vectors count as
    filled up with zeros. Components beyond +-sqrt(2^53 / width) are drawn in to it: no inner product then
    exceeds what a double holds exactly.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    width = max(1, good.agg(F.max(F.size("embedding"))).first()[0] or 1)
    most = min((1 << 31) - 1, int((2.0**53 / width) ** 0.5))
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-most))), F.lit(float(most)))).cast("int"))
    v = F.concat(whole, F.array_repeat(F.lit(0), F.lit(width) - F.size("embedding")))
    out = good.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), v.alias("v"))
    return out.withColumn("n2", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x.cast("bigint")))


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows as whole_rows() gives them. ``anchors`` says of a row whether it is one (those without an id are not); equal
    rows are one anchor. An anchor's positives are its first ``positives`` other rows of its label; for each, its
    negatives are the first ``negatives`` rows of other labels with low * p <= 100 * score <= high * p for the positive's score p.
    Higher scores come first, ties by smaller id (null last). Other rows are those of another id; rows that
    share an id each count. No rows, or anchors without positives or with empty windows, give no rows.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    rows = scratch.save(rows, "vectors")
    total, longest2, width = rows.agg(F.count("*"), F.max("n2"), F.max(F.size("v"))).first()
    if not total:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = Index.over(rows, width, longest2, total, scratch, cell_rows, block)
    asked = rows.where(anchors & F.col("id").isNotNull()).dropDuplicates(["id", "label", "v"])
    asked = scratch.save(asked.withColumn("q", F.monotonically_increasing_id() * positives), "anchors")
    any_ = F.lit(None).cast("bigint")
    near = index.best(asked.select("q", F.col("id").alias("skip"), "label", "v", "n2", any_.alias("lo"), any_.alias("hi")), positives, True)
    near = near.select("q", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("q") + F.col("rank") - 1).alias("p"))
    pairs = asked.join(near, "q").withColumn("lo", _floor_div(-F.col("positive_score") * low, 100) * -1).withColumn("hi", _floor_div(F.col("positive_score") * high, 100))
    pairs = scratch.save(pairs.where("lo <= hi"), "pairs")
    far = index.best(pairs.select(F.col("p").alias("q"), F.col("id").alias("skip"), "label", "v", "n2", "lo", "hi"), negatives, False)
    far = far.select(F.col("q").alias("p"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.select("p", F.col("id").alias("anchor_id"), "positive_id", "positive_score").join(far, "p").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _floor_div(a: Column, b: int) -> Column:
    """floor(a / b) in whole numbers, b > 0."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))
