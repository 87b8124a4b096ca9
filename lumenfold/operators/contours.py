"""Rings from segments: outlines of tiles, ways of a relation, lines of equal value."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import checks

RINGS = "ring int, closed boolean, points array<struct<x:double,y:double>>"


def walk(lines: list[list[tuple[float, float]]]) -> list[tuple[bool, list[tuple[float, float]]]]:
    """Lines joined at equal ends: (closed, points), in the order of their smallest line.

    A closed ring does not repeat its first point. Where more than two ends meet, the sharpest
    left turn is not sought: the first unused line in order is taken.
    """
    ends: dict[tuple[float, float], list[int]] = defaultdict(list)
    for k, line in enumerate(lines):
        ends[line[0]].append(k)
        ends[line[-1]].append(k)
    used = [False] * len(lines)

    def grow(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
        while points[0] != points[-1]:
            k = next((k for k in ends[points[-1]] if not used[k]), None)
            if k is None:
                break
            used[k] = True
            points += lines[k][1:] if lines[k][0] == points[-1] else lines[k][-2::-1]
        return points

    out = []
    for k, line in enumerate(lines):
        if not used[k]:
            used[k] = True
            points = grow(grow(list(line))[::-1])[::-1]
            closed = len(points) > 3 and points[0] == points[-1]
            out.append((closed, points[:-1] if closed else points))
    return out


def stitched(lines: DataFrame, key: str) -> DataFrame:
    """key, ring, closed, points: the ways of each key joined at equal ends, in any order and direction.

    lines: key, ord, points array<struct<x,y>>. A key's lines (a relation's ways, a component's
    edges) are walked together, many keys in a batch. Lines of fewer than two points are passed over.
    """
    fit = lines.select(key, "ord", F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("points"))
    own = F.array_sort(F.collect_list(F.struct(F.col("ord").isNull().alias("last"), "ord", "points")))
    rows = fit.where("size(points) >= 2").groupBy(key).agg(F.transform(own, lambda w: w["points"]).alias("lines"))
    return rows.mapInArrow(_walked, f"{key} {lines.schema[key].dataType.simpleString()}, {RINGS}")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """walk() of the rows of (key, lines) of each batch: key, and RINGS."""
    for batch in batches:
        ways = batch.column(1).flatten()
        at = ways.flatten()
        xy = list(zip(at.field("x").to_pylist(), at.field("y").to_pylist(), strict=True))
        ends = [0, *np.cumsum(ways.value_lengths().to_numpy(zero_copy_only=False)).tolist()]
        upto = [0, *np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)).tolist()]
        of, ring, closed, size, found = [], [], [], [0], []
        for row, (a, b) in enumerate(zip(upto, upto[1:], strict=False)):
            for n, (shut, points) in enumerate(walk([xy[ends[k] : ends[k + 1]] for k in range(a, b)])):
                of.append(row)
                ring.append(n)
                closed.append(shut)
                found += points
                size.append(len(found))
        corners = pa.StructArray.from_arrays([pa.array([p[k] for p in found], pa.float64()) for k in (0, 1)], ["x", "y"])
        columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(ring, pa.int32()), pa.array(closed, pa.bool_()), pa.ListArray.from_arrays(pa.array(size, pa.int32()), corners)]
        yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "ring", "closed", "points"])


#: By how many quarter turns to the left an edge goes on: rather left, then straight, then right. (Fixed values.)
TURNS = (1, 0, 3)


def ranked(links: DataFrame) -> DataFrame:
    """id, ring, pos, closed of links (id, after: the id that follows, or null): the order of every chain.

    A closed ring is named after its smallest id and begins there, an open one after its last id. Every id follows
    at most one other. Pointers jump over twice as many links in each round, so rounds
    grow with the logarithm of the longest chain, which is never gathered anywhere; each is an equi-join of
    distinct ids, written once to a table in the shared folder. Tables pack to a small part of their rows' size, so none is left to be broadcast by it.
    """
    return _ranked(checks.cut(links))


def _ranked(links: DataFrame) -> DataFrame:
    """ranked(); where links have n, an id counts as so many."""
    hops = (F.col("n") if "n" in links.columns else F.lit(1)).cast("bigint").alias("hops")
    jumped = _jump(links.select("id", F.col("after").alias("to"), F.col("id").alias("low"), hops, F.col("id").alias("last")))
    round_ = jumped.where("to is not null").select("id", F.col("low").alias("ring")).hint("merge")
    opened = links.join(round_, "id").select("id", F.when(F.col("after") != F.col("ring"), F.col("after")).alias("to"), F.col("id").alias("low"), hops, F.col("id").alias("last"))
    of_rings = _jump(opened).join(round_, "id").select("id", "ring", "hops", F.lit(True).alias("closed"))
    of_lines = jumped.where("to is null").select("id", F.col("last").alias("ring"), "hops", F.lit(False).alias("closed"))
    both = of_rings.unionByName(of_lines)
    length = both.groupBy("ring", "closed").agg(F.max("hops").alias("n"))
    return both.join(length.hint("merge"), ["ring", "closed"]).select("id", "ring", (F.col("n") - F.col("hops")).alias("pos"), "closed")


def _jump(state: DataFrame) -> DataFrame:
    """state (id, to, low, hops, last) with pointers that have jumped until chains have ended and rings know their smallest id."""
    before = None
    while True:
        there = state.select(F.col("id").alias("__id"), F.col("to").alias("__to"), F.col("low").alias("__low"), F.col("hops").alias("__hops"), F.col("last").alias("__last")).hint("merge")
        went = F.col("__id").isNotNull()
        after = state.join(there, F.col("to") == F.col("__id"), "left").select(
            "id", F.when(went, F.col("__to")).alias("to"), F.when(went, F.least("low", "__low")).otherwise(F.col("low")).alias("low"),
            F.when(went, F.col("hops") + F.col("__hops")).otherwise(F.col("hops")).alias("hops"), F.when(went, F.col("__last")).otherwise(F.col("last")).alias("last"),
            (went & (F.col("__low") < F.col("low"))).alias("lower"),
        )
        after = checks.cut(after)
        mark = after.agg(F.count_if("lower").alias("lower"), F.count_if(F.col("to").isNull()).alias("ended")).first()
        state = after.drop("lower")
        if mark.lower == 0 and mark.ended == before:
            return state
        before = mark.ended


def outline_links(edges: DataFrame, *keys: str) -> DataFrame:
    """id, after of edges (x1, y1, x2, y2 and their tile i, j; see outline_edges()): each with its tile on the left.

    id: struct<keys, x, y, d> of the edge's start and direction (0 east, 1 north, 2 west, 3 south). Where four edges meet, tiles that touch by a corner alone
    stay apart (TURNS).
    """
    south, west = (F.col("y1") == F.col("y2")) & (F.col("y1") == F.col("j")), (F.col("x1") == F.col("x2")) & (F.col("x1") == F.col("i"))
    level = F.col("y1") == F.col("y2")
    d = F.when(south, 0).when(level, 2).when(west, 3).otherwise(1)
    at = lambda c: F.when(d < 2, F.least(f"{c}1", f"{c}2")).otherwise(F.greatest(f"{c}1", f"{c}2"))
    to = lambda c: F.when(d < 2, F.greatest(f"{c}1", f"{c}2")).otherwise(F.least(f"{c}1", f"{c}2"))
    e = edges.select(*keys, F.struct(*keys, at("x").alias("x"), at("y").alias("y"), d.alias("d")).alias("id"), to("x").alias("tx"), to("y").alias("ty"))
    other = e.select(*keys, F.col("id").alias("next"), F.col("id.x").alias("tx"), F.col("id.y").alias("ty"))
    turn = F.pmod(F.col("next.d") - F.col("id.d"), F.lit(4))
    return e.join(other.hint("merge"), [*keys, "tx", "ty"]).groupBy("id").agg(F.min_by("next", F.array_position(F.array(*map(F.lit, TURNS)), turn)).alias("after"))


def outline_points(edges: DataFrame, *keys: str) -> DataFrame:
    """ring, pos, x, y, d, came, corner: the edges' starts and directions along every closed outline, as rows, however long it is.

    came: the direction of the edge before; corner: whether it is another. Outer rings run anticlockwise, those of holes clockwise. A ring is named after its smallest edge. Edges are walked
    within blocks of tiles first, so that only the chains between blocks' borders are put in order by pointers.
    """
    links = outline_links(edges, *keys)
    own = {f.name: f.dataType.simpleString() for f in links.schema["id"].dataType}
    named = lambda c: F.struct(*keys, *(F.col(f"{c}{k}").cast(own[k]).alias(k) for k in "xyd"))
    flat = links.select(*(F.col(f"id.{k}").alias(k) for k in keys), *(F.col(f"{c}.{k}").cast("bigint").alias(f"{n}{k}") for c, n in (("id", ""), ("after", "a")) for k in "xyd"))
    blocks = flat.withColumn("bx", F.floor(F.col("x") / BLOCK)).withColumn("by", F.floor(F.col("y") / BLOCK)).groupBy(*keys, "bx", "by")
    schema = ", ".join([*(f"{k} {own[k]}" for k in keys), *(f"{c} bigint" for c in _WALKED), "came bigint", "shut boolean"])
    walked = checks.cut(blocks.applyInArrow(_block_walk, schema))
    chains = checks.cut(walked.where("not shut and off = 0").select(named("").alias("id"), named("a").alias("after"), "n", named("l").alias("low"), "lowoff", "ends"))
    order = checks.cut(_ranked(chains.select("id", "after", "n")))
    whole = chains.join(order.hint("merge"), "id")
    rings = whole.groupBy("ring").agg(F.min(F.struct("low", (F.col("pos") + F.col("lowoff")).alias("at"))).alias("low"), F.sum("n").alias("length"))
    comes = chains.select(F.col("after").alias("id"), F.col("ends").alias("led"))
    heads = whole.join(rings.withColumnRenamed("low", "first").hint("merge"), "ring").join(comes.hint("merge"), "id").select(F.col("id").alias("head"), F.col("first.low").alias("ring"), F.col("first.at").alias("at"), "pos", "length", "led")
    at = [F.col(k).cast(own[k]).alias(k) for k in "xyd"]
    open_ = walked.where("not shut").withColumn("head", named("h")).join(heads.hint("merge"), "head")
    open_ = open_.select("ring", F.pmod(F.col("pos") + F.col("off") - F.col("at"), F.col("length")).alias("pos"), *at, F.when(F.col("off") == 0, F.col("led")).otherwise(F.col("came")).alias("came"))
    both = open_.unionByName(walked.where("shut").select(named("h").alias("ring"), F.col("off").alias("pos"), *at, "came"))
    return both.withColumn("corner", F.col("came") != F.col("d"))


#: Side of the blocks of tiles in which outlines are walked at once: a block has at most four edges for each of its tiles.
BLOCK = 64
#: An edge's start and direction, its chain's first edge and its place after that; of a chain's first edge also what follows the chain's last,
#: how many it has, its smallest edge with its place, and the direction of its last.
_WALKED = ("x", "y", "d", "hx", "hy", "hd", "off", "ax", "ay", "ad", "n", "lx", "ly", "ld", "lowoff", "ends")


def _block_walk(edges: pa.Table) -> pa.Table:
    """The edges of one block along the chains that they make in it. shut: the chain is a whole ring, which then begins at its smallest edge; came: the direction of the edge before, null where a chain begins."""
    ids, after = (list(zip(*(edges.column(f"{n}{k}").to_pylist() for k in "xyd"), strict=True)) for n in ("", "a"))
    at = {e: k for k, e in enumerate(ids)}
    follows = [at.get(e) for e in after]
    led = {k for k in follows if k is not None}
    done, rows, taken = [False] * len(ids), [], []
    in_order = sorted(range(len(ids)), key=ids.__getitem__)
    for first in [*(k for k in in_order if k not in led), *in_order]:
        if done[first]:
            continue
        chain, k = [], first
        while k is not None and not done[k]:
            done[k] = True
            chain.append(k)
            k = follows[k]
        shut, last = k is not None, chain[-1]
        low = min(range(len(chain)), key=lambda j: ids[chain[j]])
        told = (*after[last], len(chain), *ids[chain[low]], low, ids[last][2])
        for off, e in enumerate(chain):
            before = ids[chain[off - 1]][2] if off or shut else None
            rows.append((*ids[e], *ids[first], off, *(told if off == 0 else (None,) * len(told)), before, shut))
        taken += chain
    keys = [c for c in edges.column_names if c not in ("x", "y", "d", "ax", "ay", "ad", "bx", "by")]
    columns = dict(zip((*_WALKED, "came", "shut"), zip(*rows, strict=True), strict=True))
    own = edges.select(keys).take(pa.array(taken, pa.int64())) if keys else None
    arrays = [*(own.column(k) for k in keys), *(pa.array(columns[c], pa.int64()) for c in (*_WALKED, "came")), pa.array(columns["shut"], pa.bool_())]
    return pa.table(arrays, [*keys, *_WALKED, "came", "shut"])


def outline_rings(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The closed outlines of each component of tiles: component, ring, closed, points (every unit edge's start).

    edges: outline_edges() with the tile (i, j) that each belongs to; components: i, j, component. A ring is put
    in order by ranked(); only its own points meet in its row.
    """
    of_tile = components.select("component", "i", "j")
    d = F.col("ring.d")
    i = F.when(d == 0, F.col("ring.x")).when(d == 1, F.col("ring.x") - 1).when(d == 2, F.col("ring.x") - 1).otherwise(F.col("ring.x"))
    j = F.when(d == 0, F.col("ring.y")).when(d == 1, F.col("ring.y")).when(d == 2, F.col("ring.y") - 1).otherwise(F.col("ring.y") - 1)
    point = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rings = outline_points(edges).groupBy("ring").agg(F.array_sort(F.collect_list(F.struct("pos", point.alias("p")))).alias("ps"))
    rings = rings.select("ring", F.transform("ps", lambda q: q["p"]).alias("points"), i.alias("i"), j.alias("j")).join(of_tile, ["i", "j"])
    nth = F.row_number().over(Window.partitionBy("component").orderBy("ring")) - 1
    return rings.select("component", nth.alias("ring"), F.lit(True).alias("closed"), "points")


def filled(cells: DataFrame) -> DataFrame:
    """cells (i, j, outdoor, sunny) on one grid with those that are indoors or missing filled: i, j, outdoor, sunny, known.

    Such a cell within the grid's bounds takes sunny from the first outdoor one of its neighbours south, north, west, east (by j, then i);
    without one it is not sunny and ``lit`` is null. known: whether the cell was there. Of repeated cells the largest (outdoor, sunny) counts.
    """
    own = cells.groupBy("i", "j").agg(F.max(F.struct("outdoor", "sunny")).alias("c")).select("i", "j", "c.outdoor", "c.sunny")
    out = own.where("outdoor")
    bounds = own.agg(*(f(c).alias(f"{n}_{c}") for c in "ij" for n, f in (("lo", F.min), ("hi", F.max))))
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(((0, -1), (0, 1), (-1, 0), (1, 0)))))
    near = out.withColumn("s", F.explode(steps)).select((F.col("i") - F.col("s.a")).alias("i"), (F.col("j") - F.col("s.b")).alias("j"), "s.k", "sunny")
    near = near.join(F.broadcast(bounds), F.col("i").between(F.col("lo_i"), F.col("hi_i")) & F.col("j").between(F.col("lo_j"), F.col("hi_j")))
    near = near.groupBy("i", "j").agg(F.min_by("sunny", "k").alias("near"))
    both = own.withColumn("known", F.lit(True)).join(near, ["i", "j"], "full")
    lit = F.when(F.coalesce("outdoor", F.lit(False)), F.col("sunny")).otherwise(F.col("near"))
    return both.select("i", "j", F.coalesce("outdoor", F.lit(False)).alias("outdoor"), lit.alias("lit"), F.coalesce("known", F.lit(False)).alias("known"))


def unified_contours(cells: DataFrame) -> DataFrame:
    """layer (sunny, shadow, buildings), ring, pos, x, y of the lines at one half over all tiles' cells (i, j, outdoor, sunny), and bx, by of the point before.

    Cells of neighbouring tiles share one grid, so lines run on over their borders; gaps and indoor cells are filled() first. Buildings are the
    indoor cells themselves. At one half a line passes through the middles of the sides between cells that are in
    the layer and cells that are not; diagonal cells stay apart.
    """
    known = filled(cells)
    of = F.array_compact(F.array(F.when(F.col("lit"), "sunny"), F.when(~F.col("lit"), "shadow"), F.when(F.col("known") & ~F.col("outdoor"), "buildings")))
    points = outline_points(checks.outline_edges(known.select("i", "j", F.explode(of).alias("layer")), "layer"), "layer")
    on = lambda c, d, plus, minus: F.col(c) + F.when(F.col(d) == plus, 0.5).when(F.col(d) == minus, -0.5).otherwise(0.0)
    return points.select("ring.layer", "ring", "pos", on("x", "d", 0, 2).alias("x"), on("y", "d", 1, 3).alias("y"), on("x", "came", 2, 0).alias("bx"), on("y", "came", 3, 1).alias("by"))


def isolines(cells: DataFrame, level: float = 0.5) -> DataFrame:
    """Marching squares: i, j, points of the line of a level in each square of four neighbouring cell centres.

    cells: i, j, value. Squares that miss a cell have no line. In a saddle the middle's mean decides.
    """
    take = lambda di, dj, name: cells.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("value").alias(name))
    sq = take(0, 0, "a").join(take(1, 0, "b"), ["i", "j"]).join(take(1, 1, "c"), ["i", "j"]).join(take(0, 1, "d"), ["i", "j"])
    x, y = F.col("i").cast("double"), F.col("j").cast("double")
    part = lambda u, v: (F.lit(level) - F.col(u)) / (F.col(v) - F.col(u))
    pt = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    south, east, north, west = pt(x + part("a", "b"), y), pt(x + 1, y + part("b", "c")), pt(x + part("d", "c"), y + 1), pt(x, y + part("a", "d"))
    over = lambda c: (F.col(c) > level).cast("int")
    case = over("a") + 2 * over("b") + 4 * over("c") + 8 * over("d")
    middle = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 > level
    two = lambda p, q, r, s: F.array(F.array(p, q), F.array(r, s))
    lines = F.when(case.isin(1, 14), F.array(F.array(west, south))).when(case.isin(2, 13), F.array(F.array(south, east))).when(case.isin(4, 11), F.array(F.array(east, north)))
    lines = lines.when(case.isin(8, 7), F.array(F.array(north, west))).when(case.isin(3, 12), F.array(F.array(west, east))).when(case.isin(6, 9), F.array(F.array(south, north)))
    lines = lines.when((case == 5) == middle, two(west, north, south, east)).otherwise(two(west, south, east, north))
    return sq.where(~case.isin(0, 15)).select("i", "j", F.explode(lines).alias("points"))
