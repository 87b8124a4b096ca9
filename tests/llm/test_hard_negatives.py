import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import hard_negatives, queries


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    """Over all pairs, as the contract says; rows of one id each count, equal anchors once."""
    good = [(i, y, [math.floor(scale * float(np.float32(x))) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for i, y, v in {(i, y, tuple(v)) for i, y, v in good if i is not None and i % every == 0}:
        scored = [(j, sum(a * b for a, b in zip(v, w, strict=False)), z == y) for j, z, w in good if j != i]
        for p in sorted((s for s in scored if s[2]), key=by)[:positives]:
            fits = sorted((s for s in scored if not s[2] and low * p[1] <= 100 * s[1] <= high * p[1]), key=by)
            out += [(i, p[0], k, s[0], p[1], s[1]) for k, s in enumerate(fits[:negatives], 1)]
    return sorted(out, key=repr)


def mined(df, every=100, **more):
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.whole_rows(df), F.col("id") % every == 0, **more).collect()), key=repr)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_query_against_sql(spark, scale):
    folder = f"/root/testdata/{scale}"
    got = queries.op11_hard_negatives(spark, folder)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op11_hard_negatives"]).fetchall())
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def clustered(n, seed, width=6):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(12)]
    return [(k, rng.randrange(4), [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for k in range(n)]


def test_clusters_ties_and_many_cells(spark):
    rows = clustered(900, 3)
    rows += [(2000 + k, k % 3, [0.5] * 6) for k in range(500)]  # a third of the rows is one vector
    assert mined(rows_of(spark, rows), 50, cell_rows=64, block=100) == brute(rows, 50)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [0.5, 0.5]), (1, 1, [0.9, 0.4]), (1, 1, [0.9, 0.4]), (2, 2, [0.5, 0.1]), (3, 2, [0.4, 0.3]), (None, 2, [0.5, 0.1]), (None, 1, [2.0, 0.4]),
        (4, None, [1.0, 1.0]), (5, 1, None), (6, 1, [nan, 1.0]), (7, 1, [inf, 1.0]), (8, 1, [None, 1.0]), (9, 2, [0.7]), (10, 2, []), (-100, 2, [-0.5, -0.1]), (100, 3, [0.0, 0.0]), (200, 9, [1.0, 1.0]),
    ]
    df = rows_of(spark, rows)
    assert mined(df) == brute(rows)
    assert mined(df.limit(0)) == [] and mined(rows_of(spark, rows[:1])) == []
    huge = rows_of(spark, [(0, 1, [3e38]), (1, 1, [3e38]), (2, 2, [1e-3]), (3, 2, [-3e38])])
    assert mined(huge) == []


def test_large_numbers_are_exact(spark):
    rng = random.Random(9)
    rows = [(k, k % 2, [float(np.float32(rng.uniform(-3e4, 3e4))) for _ in range(3)]) for k in range(300)]
    assert mined(rows_of(spark, rows), 10, cell_rows=32) == brute(rows, 10)


@pytest.mark.parametrize("seed", range(4))
def test_tree_bounds_hold_and_leaves_are_small(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-60, 60, (700, 5))
    x[100:400] = x[100]
    points = hard_negatives.augmented(x, int((x * x).sum(1).max()))
    tree = hard_negatives.build(points, 16)
    assert sorted(tree.order.tolist()) == list(range(700)) and np.diff(tree.starts).max() <= 16
    q = rng.normal(0, 50, (9, 6))
    low, high = hard_negatives.bounds(np.linalg.norm(q[:, None] - points[tree.vantage][None], axis=2), tree.path, tree.near, tree.far)
    for leaf in range(len(tree.starts) - 1):
        d = np.linalg.norm(q[:, None] - points[tree.order[tree.starts[leaf] : tree.starts[leaf + 1]]][None], axis=2)
        assert (low[:, leaf] <= d.min(1) + 1e-9).all() and (high[:, leaf] >= d.max(1) - 1e-9).all()


def test_search_passes_leaves_over():
    """Clusters far apart: leaves outside the annulus are not read."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1, (256, 3)) for c in ([0, 0, 0], [900, 0, 0], [0, 900, 0], [0, 0, 900])]).round().astype(np.int32)
    longest2 = int((x.astype(int) ** 2).sum(1).max())
    tree = hard_negatives.build(hard_negatives.augmented(x, longest2), 64)
    asked = hard_negatives.Annuli(np.array([[900, 0, 0]], np.int32), [900 * 850], [None], longest2)
    key = asked.leaves(x[tree.vantage], tree.path, tree.near, tree.far)
    assert np.isfinite(key).sum() <= len(key[0]) // 2
