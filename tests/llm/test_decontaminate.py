import random
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, items, window):
    d = words(doc)
    hit, found = set(), set()
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(d) - n + 1):
                if d[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(d), hit, sorted(found)


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_brute_force(seed):
    rng = random.Random(seed)
    vocab = "abcd"[: 2 + seed % 3]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))) for k in range(12)]
    auto = dc.ItemAutomaton([(k, words(t)) and (k, dc.words(t)) for k, t in items], window=5)
    for _ in range(40):
        doc = " ".join(rng.choice(vocab + "z") for _ in range(rng.randint(0, 40)))
        n, hit, found = brute(doc, items, 5)
        spans, got = auto.hits(dc.words(doc))
        assert {p for a, b in spans for p in range(a, b)} == hit
        assert sorted(map(str, got)) == found
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert n == len(dc.words(doc))


def test_shares_of_a_long_benchmark_give_the_same(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text")
    one = dc.matches(docs, bench).orderBy("doc_id").collect()
    many = dc.matches(docs, bench, bound=300).orderBy("doc_id").collect()
    assert one == many and any(r.spans for r in one)


def test_defined_cases(spark):
    item = " ".join(f"Item{k}" for k in range(15))
    bench = spark.createDataFrame([(10, item), (9, item), (2, "just three words"), (3, ""), (4, None), (None, "null id here")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, f"before, {item.upper()} after"), (4, "Just-three.WORDS!"), (5, "null id here"), (6, "w " * 400 + item), (6, "w " * 400 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("spans", F.lit("s"))
    got = {r.doc_id: r for r in dc.matches(docs, bench).collect()}
    assert got[1].n_words == got[2].n_words == 0 and got[1].spans == []
    assert got[3].items == ["10", "9"] and [(s.start, s.end) for s in got[3].spans] == [(1, 16)]
    assert got[4].items == ["2"] and got[5].items == []
    kept = dc.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 6]
    cut = {r.doc_id: r.text for r in dc.remove_spans(docs, bench, share=0.99).collect()}
    assert cut[3] == "before, after" and 4 not in cut and cut[6].strip() == ("w " * 400).strip()
    assert dc.matches(docs.limit(0), bench).count() == 0
    assert all(r.spans == [] for r in dc.matches(docs, bench.limit(0)).collect())
