import hashlib
import math
import re
import zlib

import pytest

from lumenfold.llm import importance, queries

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def runs(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return w, [zlib.crc32(g) % 10000 for g in w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]]


def brute(docs, target):
    """docs: (doc_id, text). The contract, word by word."""
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in runs(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        w, f = runs(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    can = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(can[: 25 * len(can) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = queries.op13_importance_resampling(spark, small)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, target), key=key)


def test_nulls_repeats_ties_and_clashing_names(spark):
    text = "One two THREE é four " * 6
    docs = [(1, text), (1, text), (None, text), (None, text), (2, None), (3, ""), (4, "!?"), (5, "word"), *((k, f"{text} {k % 3}") for k in range(10, 60))]
    df = spark.createDataFrame([(*d, 9, 9, 9, 9) for d in docs], "doc_id long, text string, importance int, row int, score int, __id int")
    target = spark.createDataFrame([("one two three",), (None,)], "text string")
    got = importance.resample(df, target).collect()
    want = brute(docs, ["one two three", None])
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted([r[:4] for r in want], key=key)
    ranks = sorted(r.rank for r in got if r.rank is not None)
    assert ranks == list(range(1, 25 * 54 // 100 + 1))
    by = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [-r.score for r in by] == sorted(-r.score for r in by)
    assert importance.resample(df.limit(0), target).collect() == []
    assert importance.weigh(df, importance.learn(df, target)).columns == ["doc_id", "text", "row", "score", "__id", "importance"]


def test_one_score_with_most_rows(spark, tmp_path):
    from lumenfold.llm.common import Scratch

    scored = spark.range(5000).selectExpr("id AS row", "(id * 7919) % 5000 AS doc_id", "CAST(if(id % 10 < 7, 5, id % 10) AS BIGINT) AS score")
    got = {r.row: r["rank"] for r in importance.draw(scored, Scratch(spark, "t"), 60).collect()}
    order = sorted(scored.collect(), key=lambda r: (-r.score, r.doc_id))
    assert got == {r.row: k for k, r in enumerate(order[:3000], 1)}


@pytest.mark.parametrize("size", [1, 2, 3, 4])
@pytest.mark.parametrize("most", [1, 5, 64, 1 << 20])
def test_pieces_give_the_same_features(size, most):
    data = ("Aé b-C dd  1a\n" * 9).encode()
    w = WORD.findall(data.translate(LOWER))
    want = sorted(zlib.crc32(b" ".join(w[i : i + n])) % 997 for n in range(1, size + 1) for i in range(len(w) - n + 1))
    got = list(importance.features(data, size, 997, most))
    assert sorted(b for _, found in got for b in found.tolist()) == want and sum(n for n, _ in got) == len(w)
