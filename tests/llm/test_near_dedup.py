import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import near_dedup


def brute(rows, size, percent=80):
    """doc_id -> (number of shingles, component), by comparing all pairs of exact sets."""
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        n = max(1, len(words) - size + 1) if words else 0
        sets[doc] = {tuple(words[i : i + size]) for i in range(n)}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def check(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, size=size).collect()
    want = brute(rows, size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows)


def test_documents_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(spark, rows, 4)


def test_chains_and_groups_of_edited_copies(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = [(0, " ".join(rng.choice(vocab) for _ in range(80)))]
    chain = list(base)
    for k in range(1, 15):  # each differs from the one before in one word, so ends are far apart
        chain = list(chain)
        chain[7 * k] = f"x{k}"
        rows.append((k, " ".join(chain)))
    for k in range(15, 50):  # edits of one original, many not similar to each other
        edited = list(base)
        for _ in range(rng.randint(1, 5)):
            edited[rng.randrange(120)] = f"y{rng.randrange(1000)}"
        rows.append((k, " ".join(edited)))
    check(spark, rows, 4)
    check(spark, rows, 5)


def test_defined_cases(spark):
    text = "Alpha beta gamma delta epsilon zeta"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one TWO"), (6, text), (7, text.upper()), (8, "Été a b c d"), (9, "été a b c d"), (10, "w " * 5000)]
    check(spark, rows, 4)
    df = spark.createDataFrame([(None, text), (6, text), (6, text)], "doc_id long, text string").withColumn("kept", F.lit("x")).withColumn("component_id", F.lit(0))
    got = near_dedup.near_duplicates(df, size=4).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got) == [(False, 6, True), (False, 6, True), (True, None, True)]
    kept = near_dedup.drop_near_duplicates(df.unionByName(df.withColumn("doc_id", F.lit(9))), size=4)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 6, 6]
    assert near_dedup.near_duplicates(df.limit(0), size=4).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**63, 900, np.uint64), rng.integers(0, 2**63, (2, 50), np.uint64)
    a, b = (np.unique(np.concatenate([common, o])) for o in own)
    sk = near_dedup.Sketcher(near_dedup.BANDS, near_dedup.ROWS, near_dedup.SKETCH_WORDS)
    _, odd = sk.keys_and_sketches(np.stack([sk.minima(a), sk.minima(b)]))
    bits = sum(int(x).bit_count() for x in (odd[0] ^ odd[1]).view(np.uint64))
    assert bits <= near_dedup.most_differing_bits(0.9, near_dedup.BANDS, near_dedup.ROWS, near_dedup.SKETCH_WORDS)
    assert near_dedup.fine_level(len(a)) == 0
    fine = near_dedup.fine_sketch(a, 0) ^ near_dedup.fine_sketch(b, 0)
    differing = sum(int(x).bit_count() for x in fine.view(np.uint64))
    assert 80 <= differing <= 100  # of 100 shingles that only one set has
    assert [near_dedup.fine_level(n) for n in (1, 1024, 1025, 2048, 2049, 10**6)] == [0, 0, 1, 1, 2, 10]


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.95])
def test_threshold_grows_with_distance(similarity):
    args = (near_dedup.BANDS, near_dedup.ROWS, near_dedup.SKETCH_WORDS)
    assert near_dedup.most_differing_bits(similarity, *args) >= near_dedup.most_differing_bits(similarity + 0.04, *args)
