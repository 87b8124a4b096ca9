import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenfold.llm import packing
from lumenfold.llm.queries import vocabulary


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(vocabulary())
    return ids_of.t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer():
    rng = random.Random(4)
    signs = ["a", "B", "é", "1", "'s", " ", "\n", "\t", ".", "!!", "\U0001f642", "\xa0", "\r", "中", "<|endoftext|>", "\x00"]
    encode = packing.Encoder(vocabulary())
    assert encode.fast is not None
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert encode(text) == np.array(ids_of(text), "<u4").tobytes()


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_a_packing(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice((rng.randint(1, 64), 64, 33, 1)) for _ in range(3000))
    bins = packing.plan(counts, 64)
    used = Counter()
    for b in bins:
        assert sum(b.lengths) <= 64 and b.times > 0
        for n in b.lengths:
            used[n] += b.times
    assert used == counts
    assert [b.first for b in bins] == [sum(x.times for x in bins[:k]) for k in range(len(bins))]
    least = max(sum(n * k for n, k in counts.items()) / 64, sum(k for n, k in counts.items() if n > 32))
    assert sum(b.times for b in bins) <= 1.01 * least + 1


def test_best_two_replaces_the_smallest():
    # greedy: 60 + 30; the gap 10 and the 30 make room for 20 + 19, which fill more
    assert packing.plan({60: 1, 30: 1, 20: 1, 19: 1}, 100)[0].lengths == (60, 20, 19)
    assert packing._best_two([3, 5, 8], lambda n: 1, 11) == (8, 3)
    assert packing._best_two([4], lambda n: 1, 9) is None and packing._best_two([4], lambda n: 2, 9) == (4, 4)
    assert packing.plan({}, 8) == []
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def check(got, rows, capacity):
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    texts = dict(rows)
    for doc, parts in by_doc.items():
        ids = [*ids_of(texts[doc]), 0]
        copies = sum(1 for d, _ in rows if d == doc)
        parts = sorted(parts, key=lambda r: r.piece)[::copies]
        assert [p.start for p in parts] == list(np.cumsum([0, *(p.length for p in parts)])[:-1])
        assert sum(p.length for p in parts) == len(ids) and all(p.length == capacity for p in parts[1:])
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for parts in by_bin.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0, *(p.length for p in parts)])[:-1])
        assert sum(p.length for p in parts) <= capacity
    return len(by_bin), sum(r.length for r in got)


def test_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary()).collect()
    bins, tokens = check(got, rows, 2048)
    assert bins <= 1.05 * tokens / 2048 + 1
    assert all(np.frombuffer(r.ids, "<u4").size == r.length for r in got)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "word " * 500), (5, "\n\n  x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'e' as length", "1 as offset")
    got = packing.pack(df, vocabulary(), capacity=64, with_ids=False).collect()
    assert sum(r.doc_id == 3 for r in got) == 2 and sum(r.length for r in got if r.doc_id == 1) == 1
    check(got, rows, 64)
    assert packing.pack(df.limit(0), vocabulary()).count() == 0
