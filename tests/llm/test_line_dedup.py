import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import common
from lumenfold.llm import line_dedup as ld


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def keys_of(lines):
    """Block keys of lines given as lists of words, and the line that each is of."""
    words, line = ld.hashed_words(b"\n".join(b" ".join(ws) for ws in lines).decode())
    return ld.block_keys(*ld.fingerprints(words, line, len(lines)))


def brute(rows):
    """The texts that stay, from all pairs of lines: no key decides which are compared."""
    occ = [(d, k, tuple(ws)) for d, t in rows if t is not None and d is not None for k, ws in enumerate(ld.normal_lines(t)) if len(ws) >= ld.MIN_WORDS]
    lines = sorted({ws for _, _, ws in occ})
    parent = list(range(len(lines)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in similar_pairs(lines):
        parent[root(a)] = root(b)
    number = {ws: k for k, ws in enumerate(lines)}
    first = {}
    for d, k, ws in sorted(occ):
        first.setdefault(root(number[ws]), (d, k))
    gone = {(d, k) for d, k, ws in occ if first[root(number[ws])] != (d, k)}
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) if t is not None else None for d, t in rows}


def similar_pairs(lines):
    """All pairs whose edit similarity reaches the threshold. Lines of m words at most that are k edits apart share m - k words
    at least, counted; only pairs that share fewer are passed over without counting their edits."""
    held, longest = {}, np.array([len(ws) for ws in lines])
    members = []
    for k, ws in enumerate(lines):
        seen, mine = Counter(), []
        for w in ws:
            mine.append((w, seen[w]))
            held.setdefault((w, seen[w]), []).append(k)
            seen[w] += 1
        members.append(mine)
    held = {m: np.array(ks) for m, ks in held.items()}
    for a in range(len(lines)):
        shared = np.zeros(len(lines), np.int64)
        for m in members[a]:
            shared[held[m]] += 1
        most = np.maximum(longest, longest[a])
        for b in np.flatnonzero(shared >= most - most * (100 - ld.PERCENT) // 100).tolist():
            if b > a and 100 * edits(lines[a], lines[b]) <= (100 - ld.PERCENT) * most[b]:
                yield a, b


def test_documents_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert sum(len(t) for t in got.values()) < sum(len(t) for _, t in rows)


def test_hashes_agree_with_words(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab É1.\n\r\t\x0b") for _ in range(rng.randint(0, 2000))) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], names=["doc_id", "text"])
    want = {(d, k): ws for d, t in enumerate(texts) for k, ws in enumerate(ld.normal_lines(t)) if len(ws) >= ld.MIN_WORDS}
    for size in (300, ld.CHUNK):  # also texts that are cut at line feeds
        monkeypatch.setattr(ld, "CHUNK", size)
        got = {(r["doc_id"], r["pos"]): (r["h1"], r["h2"]) for b in ld._occurrence_batches(iter([batch])) for r in b.to_pylist()}
        assert got.keys() == want.keys()
        assert len(set(got.values())) == len({(got[k], tuple(want[k])) for k in want}) == len({tuple(ws) for ws in want.values()})


def test_one_replaced_word_always_meets():
    rng = np.random.default_rng(2)
    words = [bytes(97 + k // 26**i % 26 for i in range(3)) for k in range(500)]
    for _ in range(60):
        line = [words[k] for k in rng.choice(500, 24, replace=False)]
        other = list(line)
        other[rng.integers(24)] = b"replaced"
        keys, at = keys_of([line, other])
        assert set(keys[at == 0]) & set(keys[at == 1])


def test_defined_cases(spark):
    line = "The quick brown fox jumps over the lazy dog near 12 rivers"
    near = "The quick brown fox jumps over the crazy dog near 99 rivers"
    rows = [
        (1, f"{line}\nshort line\n\n{line.upper()}!"), (2, near), (3, None), (4, ""), (5, "short line\nshort line"), (6, "x" * 100_000), (6, "x" * 100_000),
        (None, line), (7, f"{line}\r\nmine alone stands here today"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit("p")).withColumn("n_chars", F.length("text").cast("long"))
    out = ld.dedup_lines(df)
    got = {(r.doc_id, r["__lines"], r["__removed"], r["__removed_near"]): r.text for r in out.collect()}
    assert out.columns == [*df.columns, "__removed", "__removed_near", "__lines"]
    assert got[(1, 4, 1, 0)] == f"{line}\nshort line\n"
    assert got[(2, 1, 1, 1)] == ""
    assert got[(3, 0, 0, 0)] is None and got[(4, 1, 0, 0)] == ""
    assert got[(5, 2, 0, 0)] == "short line\nshort line"
    assert got[(None, 1, 0, 0)] == line
    assert got[(7, 2, 1, 0)] == "mine alone stands here today"
    assert out.count() == len(rows)
    kept = ld.drop_repeated_lines(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.n_chars) for r in kept.collect() if r.doc_id in (1, 2, 7)) == [(1, len(line) + 12), (7, 28)]
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_recall_on_documents(spark):
    """Of all pairs of lines in the documents that the rule links, those that share a key, with the words' weights."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    lines = sorted({tuple(ws) for t in texts for ws in ld.normal_lines(t) if len(ws) >= ld.MIN_WORDS})
    halved = ld.halvings(ld.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")))
    words, line = ld.hashed_words(b"\n".join(b" ".join(ws) for ws in lines).decode())
    sketches = np.zeros((len(lines), ld.SKETCH_WORDS), np.uint64)
    bands = ld.fingerprints(words, line, len(lines), halved, sketches)[0]
    samples = (sketches[:, :, None] >> (4 * np.arange(16, dtype=np.uint64))) & np.uint64(15)
    pairs = list(similar_pairs(lines))
    alike = [(samples[a] == samples[b]).sum() >= ld.ALIKE for a, b in pairs]
    assert len(pairs) > 300 and np.mean([(bands[a] == bands[b]).any() and ok for (a, b), ok in zip(pairs, alike, strict=True)]) >= 0.99
    some = [(a, b) for a, b in zip(range(500), range(500, 1000), strict=True)] + pairs[:200]
    got = spark.createDataFrame([(k, sketches[a].view(np.int64).tolist(), sketches[b].view(np.int64).tolist()) for k, (a, b) in enumerate(some)], "k long, u array<long>, v array<long>")
    named = [F.struct(*(F.col(c)[i].alias(f"s{i}") for i in range(ld.SKETCH_WORDS))).alias(n) for c, n in (("u", "x"), ("v", "y"))]
    counted = got.select("k", *named).select("k", ld.equal_samples(common.Carried("x"), common.Carried("y")).alias("n"))
    assert {r.k: r.n for r in counted.collect()} == {k: int((samples[a] == samples[b]).sum()) for k, (a, b) in enumerate(some)}


def test_word_counts_are_of_all_documents(spark):
    rows = [("the cat\nTHE dog",), (None,), ("",), ("the end " * 70_000,)]
    got = ld.word_counts(spark.createDataFrame(rows, "text string").repartition(3))
    row = lambda w: int(ld.hashed_words(w)[0][0] % np.uint64(ld.COUNTED))
    assert (got[row("the")], got[row("end")], got[row("cat")], got.sum()) == (70_002, 70_000, 1, 140_004)
    assert ld.halvings(got)[row("the")] == 5 and ld.halvings(got)[row("cat")] == 0 and ld.word_counts(spark.createDataFrame([], "text string")).sum() == 0


def test_clashing_names_and_shorter_lines(spark):
    rows = [(1, "one two three\nfour five"), (2, "One, two, three!"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("__doc", "__drop", "__lines", "__removed", "__removed_near", "near", "first", "h1"):
        df = df.withColumn(c, F.lit(c))
    kept = ld.drop_repeated_lines(df, min_words=3)
    assert kept.columns == df.columns and [tuple(r[2:]) for r in kept.collect()] == [tuple(df.columns[2:])] * 2
    assert {r.doc_id: (r.text, r["__removed"]) for r in ld.dedup_lines(df, min_words=3).collect()} == {1: (rows[0][1], 0), 2: ("", 1), 3: (None, 0)}


def test_large_buckets_are_dealt_over_parts_and_tiles(spark, monkeypatch):
    """Buckets of many members that are not alike, and of alike ones, with parts and tiles of few."""
    monkeypatch.setattr(common, "PART", 3)
    monkeypatch.setattr(common, "TILE", 2)
    ids = [(k % 2, k) for k in range(40)] + [(9, k) for k in range(5)] + [(k + 100, j) for k in range(20) for j in (k, k + 20)]
    keys = spark.createDataFrame(ids, "key long, id long")
    for mod, few in ((1, 2), (4, 5), (7, 2), (100, 50)):
        edges = common.link_buckets(common.Scratch(spark, "test"), keys, lambda p: p.where(F.col("a") % mod == F.col("b") % mod), few=few)
        got = {r.id: r.component for r in common.connected_components(common.Scratch(spark, "test"), edges).collect()}
        linked = [(x, y) for _, x in ids for _, y in ids if x < y and x % mod == y % mod and any((k, x) in ids and (k, y) in ids for k in (0, 1, 9, *range(100, 120)))]
        want = {k: k for k in range(40)}
        for _ in range(40):
            for x, y in linked:
                want[x] = want[y] = min(want[x], want[y])
        assert all(got.get(k, k) == want[k] for k in range(40))


WORDS = [bytes(97 + k // 26**i % 26 for i in range(4)) for k in range(100_000)]


def test_lines_above_the_threshold_meet():
    rng = np.random.default_rng(7)
    for size, replaced in ((5, 1), (7, 1), (8, 1), (10, 2), (20, 2), (20, 4), (30, 3), (60, 6), (60, 12), (200, 40)):
        lines = []
        for t in range(1500):
            words = [WORDS[k] for k in rng.choice(100_000, size, replace=False)]
            other = list(words)
            for k in rng.choice(size, replaced, replace=False):
                other[k] = WORDS[rng.integers(len(WORDS))]
            lines += [words, other]
        keys, at = keys_of(lines)
        mine = [set() for _ in lines]
        for key, k in zip(keys.tolist(), at.tolist(), strict=True):
            mine[k].add(key)
        recall = sum(bool(mine[k] & mine[k + 1]) for k in range(0, len(lines), 2)) / 1500
        assert recall >= 0.99


@pytest.mark.parametrize("rarest", [False, True])
def test_recall_with_the_weights_of_a_large_corpus(rarest):
    """Real lines with a fifth of their words replaced, the rarest ones or any, and weights of the same words in a corpus
    a thousand times as large: the share that shares a band and passes the sketches, by the number of words."""
    rng = random.Random(11)
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    row = lambda w: int(ld.hashed_words(w.decode())[0][0] % np.uint64(ld.COUNTED))
    counts = np.zeros(ld.COUNTED, np.int64)
    for t in texts:
        counts += np.bincount((ld.hashed_words(t)[0] % np.uint64(ld.COUNTED)).astype(np.int64), minlength=ld.COUNTED)
    halved = ld.halvings(counts * 1000)
    held = [ws for ws in sorted({tuple(ws) for t in texts for ws in ld.normal_lines(t)}) if 5 <= len(ws) <= 60]
    lines = rng.sample(held, 1500)
    others = []
    for ws in lines:
        places = rng.sample(range(len(ws)), len(ws))
        if rarest:
            places.sort(key=lambda k: counts[row(ws[k])])
        gone = set(places[: len(ws) // 5])
        others.append([b"zq%d" % rng.randrange(10**9) if k in gone else w for k, w in enumerate(ws)])

    def prints(which):
        words, line = ld.hashed_words(b"\n".join(b" ".join(ws) for ws in which).decode())
        sketches = np.zeros((len(which), ld.SKETCH_WORDS), np.uint64)
        bands = ld.fingerprints(words, line, len(which), halved, sketches)[0]
        return bands, (sketches[:, :, None] >> (4 * np.arange(16, dtype=np.uint64))) & np.uint64(15)

    (bands, samples), (bands2, samples2) = prints(lines), prints(others)
    found = (bands == bands2).any(1) & ((samples == samples2).sum((1, 2)) >= ld.ALIKE)
    size = np.array([len(ws) for ws in lines])
    for lo, hi in ((5, 8), (8, 12), (12, 20), (20, 61)):
        assert found[(size >= lo) & (size < hi)].mean() >= 0.93
    assert found.mean() >= 0.96


def test_near_lines_go_by_the_rule_alone(spark):
    """Against all pairs of lines, without the key condition."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for d in range(60):
        words = [word() for _ in range(rng.choice((5, 6, 8, 10, 25, 60)))]
        rows.append((2 * d, " ".join(words)))
        for _ in range(int(0.2 * len(words))):
            words[rng.randrange(len(words))] = word()
        rows.append((2 * d + 1, " ".join(words)))
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: "" if d % 2 else t for d, t in rows}


def test_rows_of_other_figures_stay(spark):
    rows = [(1, "12.5 33.2 44.1 2024-05-01"), (2, "98.7 10.4 56.3 1999-12-31"), (3, "12.5 33.2 44.1 2024-05-01")]
    kept = ld.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == rows[:2]


def test_scripts_without_spaces(spark):
    line, near = "这是一个在许多文件中重复出现的长句子没有空格", "这是一个在许多文件中重复出现的长句孑没有空格"
    rows = [(1, line), (2, line), (3, near), (4, "それぞれの文書に一度だけ現れる別の行です")]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {1: line, 2: "", 3: "", 4: rows[3][1]}


def test_lines_of_one_large_group_meet_few_others(spark, monkeypatch):
    """Variants of one line: a few pairs a line are tried, not all pairs of every small bucket, and one line stays."""
    rng = random.Random(3)
    base = [f"w{k:02}" for k in range(40)]
    rows = [(d, " ".join(w if rng.random() > 0.05 else f"x{rng.randrange(10**6)}" for w in base)) for d in range(400)]
    alone = [(1000 + d, " ".join(f"y{rng.randrange(10**6)}" for _ in range(8))) for d in range(50)]
    tried = []
    save = common.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name == "candidates":
            tried.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "save", counted)
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(rows + alone, "doc_id long, text string")).collect()}
    assert got == {d: t if d in (0, *range(1000, 1050)) else "" for d, t in rows + alone}
    assert sum(tried) <= 4 * len(rows)


def test_shared_keys_of_parts_of_any_size(monkeypatch):
    """Keys that two lines have, with parts that are looked through before they are whole."""
    rng = np.random.default_rng(4)
    keys = np.concatenate((rng.integers(0, 3000, 4000), np.full(700, 5000), np.full(300, 5001)))
    keys = rng.permutation(keys) * 64 + 7
    ids = np.arange(len(keys))
    monkeypatch.setattr(ld, "LARGE", 40)
    held = [ld._dealt_keys([(keys[i : i + 250], ids[i : i + 250])], 64) for i in range(0, 5000, 250)]
    want = {(k, i) for k, i in zip(keys.tolist(), ids.tolist(), strict=True) if (keys == k).sum() > 1}
    for size in (1 << 20, 200):
        monkeypatch.setattr(ld, "PART_KEYS", size)
        got = [r for b in ld._shared_batches(iter(held)) for r in b.to_pylist()]
        assert len(got) == len(want) and {(r["key"], r["id"]) for r in got} == want
        assert all((r["n"] > 40) == ((keys == r["key"]).sum() > 40) for r in got)


def test_profiles_bound_the_edit_distance():
    """Words replaced, taken out and put in: profiles differ by twice the edit distance at most."""
    rng = random.Random(9)
    for _ in range(200):
        a = [WORDS[rng.randrange(300)] for _ in range(rng.randint(1, 300))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [WORDS[rng.randrange(300)] for _ in range(rng.randint(0, 1))]
        if b:
            words, line = ld.hashed_words(b"\n".join(b" ".join(ws) for ws in (a, b)).decode())
            x, y = ld.profiles(words, line, 2)
            assert ld.profile_distance(x, y) <= 2 * edits(a, b)


def test_lines_that_only_look_alike_are_not_tried_in_all_pairs(spark, monkeypatch):
    """Lines with the same half of their words share bands and many samples; beyond the first pass none of their pairs is tried."""
    rng = random.Random(6)
    base = [f"w{k:02}" for k in range(40)]
    rows = []
    for d in range(80):
        gone = set(rng.sample(range(40), 10))
        rows.append((d, " ".join(f"x{rng.randrange(10**6)}" if k in gone else w for k, w in enumerate(base))))
    tried = []
    save = common.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name == "candidates":
            tried.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "save", counted)
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == dict(rows)
    assert 0 < sum(tried) <= len(rows)


def test_pairs_of_buckets_of_any_size(monkeypatch):
    """Forests connect what all pairs that fit connect, and the closest pairs are the best ones, whatever is looked through at once."""
    rng = np.random.default_rng(8)
    n = 300
    key = np.sort(np.concatenate((np.repeat([1, 2, 3], [120, 40, 14]), rng.integers(10, 50, n - 174))))
    near = rng.integers(0, 2**63, (9, ld.SKETCH_WORDS))[rng.integers(0, 9, n)]
    c = rng.integers(0, 6, n)
    cols = {"key": key, "id": np.arange(n), "words": np.full(n, 20), "c": c} | {f"s{i}": near[:, i] ^ (rng.integers(0, 2, n) << 62) for i in range(ld.SKETCH_WORDS)}
    table = pa.table(cols)

    def found(which):
        return [(r["key"], r["a"], r["b"], r["alike"]) for b in ld._pair_batches(iter(table.to_batches(max_chunksize=30)), which, 80) for r in b.to_pylist()]

    for square, few, held in ((512, 16, 1 << 16), (20, 3, 50), (1, 1, 1)):
        for name, value in (("SQUARE", square), ("FEW_LINES", few), ("HELD_ROWS", held)):
            monkeypatch.setattr(ld, name, value)
        pairs = {(k, max(a, b), min(a, b)): s for k, a, b, s in found("all_pairs")}
        sketches = np.stack([cols[f"s{i}"] for i in range(ld.SKETCH_WORDS)], axis=1).view(np.uint64)
        every = [(a, b) for a in range(n) for b in range(a) if key[a] == key[b] and c[a] != c[b]]
        want = {(int(key[a]), a, b): s for a, b in every if (s := int(ld._alike(sketches[a], sketches[b], 20, 20, np.bool_(False), 80)))}
        assert pairs == want and len(want) > 500
        best = {}
        for (k, a, b), s in pairs.items():
            ends = (k, *sorted((int(c[a]), int(c[b]))))
            best[ends] = max(s, best.get(ends, 0))
        closest = [((k, *sorted((int(c[a]), int(c[b])))), s) for k, a, b, s in found("closest")]
        if few > 3:  # buckets that are looked through many at once give all their pairs
            closest = [x for x in closest if (key == x[0][0]).sum() > few]
            best = {e: s for e, s in best.items() if (key == e[0]).sum() > few}
        assert {e: max(s for f, s in closest if f == e) for e, _ in closest} == best
        root = {(int(k), i): (int(k), i) for i, k in enumerate(key)}

        def groups(edges, root=root):
            at = dict(root)
            for _ in range(n):
                before = dict(at)
                for k, a, b in edges:
                    at[k, a] = at[k, b] = min(at[k, a], at[k, b])
                if at == before:
                    return at

        forest = [(k, a, b) for k, a, b, _ in found("forest")]
        assert groups(forest) == groups(want) and len(forest) < n
