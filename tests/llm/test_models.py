import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import common, language_id, quality, queries, toxicity


def fold(doc, k):
    return zlib.crc32(str(doc).encode()) % k


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


def test_language_is_told_on_held_out_documents(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op7_language_id(spark, sf).collect()
    assert len(got) == len(lang) and all(r.held_out == (fold(r.doc_id, 3) == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_and_quality_on_held_out_documents(spark, sf):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, what, k, fold_of, least in ((queries.op3_toxicity, "toxic", 3, 1, 0.75), (queries.op8_quality, "quality", 5, 0, 0.95)):
        got = query(spark, sf).collect()
        assert all(r.held_out == (fold(r.doc_id, k) == fold_of) and 0 <= r.score <= 1 for r in got)
        held = [(r.score, labels[r.doc_id][what]) for r in got if r.held_out and r.doc_id in labels]
        yes, no = [s for s, y in held if y], [s for s, y in held if not y]
        area = sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))
        assert area >= least


def cases(spark):
    rows = [(1, None), (2, ""), (3, "12 3.4 !?"), (4, "the of and to in is"), (4, "the of and to in is"), (None, "the of and"), (5, "der die und " * 20_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit("y"))


def test_defined_cases_of_languages(spark):
    docs = cases(spark)
    train = spark.createDataFrame([(k, f"the of and to number {k}", "en") for k in range(30)] + [(k, f"der die und das nummer {k}", "de") for k in range(30, 60)] + [(99, "x", None), (98, None, "en")], "doc_id long, text string, lang string")
    model = language_id.learn(train)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.predict(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == got[None][0] == "en" and got[5][0] == "de"
    assert sorted(r.doc_id or 0 for r in language_id.reject_unknown(docs, model).collect()) == [0, 4, 4, 5]
    assert language_id.reject_unknown(docs, model).columns == docs.columns
    junk = spark.createDataFrame([(1, "qxzj wvkq pfzx jqvw xkzq " * 20), (2, "这是一个句子" * 50), (3, "the of and to in is the of and")], "doc_id long, text string").withColumn("__lang", F.lit("l")).withColumn("__MARGIN", F.lit("m"))
    kept = language_id.reject_unknown(junk, model)
    assert [tuple(r) for r in kept.collect()] == [(3, "the of and to in is the of and", "l", "m")] and kept.columns == junk.columns
    nothing = language_id.learn(train.limit(0))
    unlabelled = language_id.learn(train.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.languages == [] and language_id.reject_unknown(docs, unlabelled).count() == docs.count()
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_defined_cases_of_scores(spark, module):
    docs = cases(spark)
    texts = spark.createDataFrame([(k, "bad awful words here" if k % 2 else "fine good words there") for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(70, 5), (71, None), (None, 1), (1000, 1)], "doc_id long, label int")
    model = module.learn(texts, labels)
    out = module.score(docs, model)
    assert out.columns == ["doc_id", "text", "label", "score"] and out.count() == 7
    assert all(0 <= r.score <= 1 for r in out.collect())
    got = {r.doc_id: r.score for r in module.score(texts, model).collect()}
    assert min(got[k] for k in range(61, 80, 2)) > max(got[k] for k in range(60, 80, 2))
    nothing = module.learn(texts, labels.limit(0))
    assert {round(r.score, 6) for r in module.score(texts, nothing).collect()} == {0.5}
    assert module.score(docs.limit(0), model).count() == 0


def test_same_texts_same_scores(spark, sf):
    a = queries.op3_toxicity(spark, sf).orderBy("doc_id").collect()
    b = queries.op3_toxicity(spark, sf).orderBy("doc_id").collect()
    assert a == b


def test_word_vectors_come_from_all_documents(spark):
    texts = ["bad awful words here", "fine good words there"] * 10 + ["unlabelled xylem grows beside phloem"] * 5
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, label int")
    got, row = quality.learn(docs, labels).vectors, quality._Rows()
    index = quality.index_vectors()
    want = sum(index[row[w]] for w in (b"xylem", b"unlabelled", b"grows", b"beside"))
    assert abs(got[row[b"xylem"]] - (5 * (want - index[row[b"xylem"]]) + index[row[b"xylem"]]) / max(1e-6, ((5 * (want - index[row[b"xylem"]]) + index[row[b"xylem"]]) ** 2).sum() ** 0.5)).max() < 1e-5


def test_many_languages_ties_and_repeated_rows_are_learned(spark):
    rng = random.Random(4)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(8)] for k in range(300)}
    rows = [(i, " ".join(rng.choice(ws) for _ in range(12)), lang) for lang, ws in words.items() for i in range(2)] + [(7, "the same text", "l000")] * 50
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=600)
    assert model.languages == sorted(words) and len(model.landmarks) == 300
    assert sum(p[0] == lang for p, lang in zip(model.predict([" ".join(words[x]) for x in sorted(words)]), sorted(words), strict=True)) >= 285


def test_kernel_and_ridge_against_plain_python():
    texts = ["the cat and the dog", "der hund und die katze", "le chien et le chat", "the of and to", "und der die das", "et le la les"]

    def grams(raw):
        return {(n, raw[i : i + n]) for n in range(1, 5) for i in range(len(raw) - n + 1)}

    parts = [language_id.segments(t)[0] for t in texts]
    x = language_id.presence(parts)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            want = len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
            assert abs(float(x[i] @ x[j]) - want) < 0.06  # hashed n-grams may share a bucket
    k, y, n = x @ x[:4].T, np.array([0, 1, 2, 0, 1, 2]), 3
    got = language_id.ridge(k, x[:4] @ x[:4].T, y, n)
    assert np.allclose(got[4], 2 / n - 1)
    for c in range(n):  # the gradient of the balanced, penalised squared loss is 0
        r = k.astype(float) @ got[:4, c] + got[4, c] - np.where(y == c, 1.0, -1.0)
        penalty = x[:4] @ x[:4].T @ got[:4, c] + 1e-6 * got[:4, c]
        assert np.abs(k.T.astype(float) @ (r / 2) + language_id.RIDGE * penalty).max() < 1e-6


def test_ftrl_against_plain_python():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(10)]
    y, weight = [k % 2 for k in range(10)], [0.5 + k / 5 for k in range(10)]
    bits, epochs = 14, 30
    model = toxicity.fit(texts, y, bits=bits, epochs=epochs, weight=weight)
    hashes = toxicity._Hashes()
    rows = [sorted(set(toxicity.features([t], hashes, bits)[1].tolist())) for t in texts]
    z, n = {}, {}

    def w(f):
        l1, zf = 0.0 if f == "bias" else toxicity.L1, z.get(f, 0.0)
        return 0.0 if abs(zf) <= l1 else -math.copysign(abs(zf) - l1, zf) / ((toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(10).tolist():
            own = [*rows[k], "bias"]
            now = {f: w(f) for f in own}
            g = weight[k] * (1 / (1 + math.exp(-sum(now.values()))) - y[k])
            for f in own:
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA * now[f]
                n[f] = n.get(f, 0.0) + g * g
    want = {f: w(f) for f in z if f != "bias" and w(f)}
    assert want and set(model.index.tolist()) == set(want) and abs(model.bias - w("bias")) < 1e-9
    assert all(abs(v - want[f]) < 1e-5 for f, v in zip(model.index.tolist(), model.weight.tolist(), strict=True))
    # n-grams of a text: words, neighbours and those with one word left out
    assert len(toxicity.features(["a b c"], hashes, bits)[1]) == 6


def test_temperature_restores_probabilities():
    rng = np.random.default_rng(3)
    z = rng.normal(0, 2, 40_000)
    yes = rng.random(40_000) < 1 / (1 + np.exp(-z))
    for stretch in (0.7, 1.0, 3.0):
        assert abs(quality.best_temperature(z * stretch, yes, np.ones(len(z))) / stretch - 1) < 0.08
    keep = yes | (rng.random(40_000) < 0.25)  # three of four zeros are left out: weights bring them back
    weight = np.where(yes, 1.0, 4.0)[keep]
    assert abs(quality.best_temperature(z[keep] * 3, yes[keep], weight) / 3 - 1) < 0.1


def test_samples_keep_both_classes_and_true_shares(spark):
    rows = [(k % 10, f"text {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)] + [(3, 1), (4, 4), (5, 0), (None, 1)], "doc_id long, label int")
    got = common.labelled_sample(docs, labels, 20, "label")
    assert sorted(got) == sorted((min(t for d, t in rows if d == k), k % 2, w) for k in range(10) if k != 5 for w in [got[0][2]])  # 5 has both labels
    assert common.labelled_sample(docs, labels.limit(0), 20, "label") == [] and common.labelled_sample(docs.limit(0), labels, 20, "label") == []
    many = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    skewed = spark.range(4000).selectExpr("id AS doc_id", "CAST(id % 20 = 0 AS INT) AS label")
    sample = common.labelled_sample(many, skewed, 300, "label")
    assert len(sample) == 300 and sum(y for _, y, _ in sample) == 150
    assert abs(sum(w for _, y, w in sample if y) / sum(w for *_, w in sample) - 0.05) < 1e-9 and abs(sum(w for *_, w in sample) - 300) < 1e-6
    assert common.labelled_sample(spark.createDataFrame([(1, "x" * 50), (2, "y")], "doc_id long, text string"), labels, 9, "label", chars=10)[0][0] == "y"


def test_scores_do_not_depend_on_whether_the_bound_is_reached(spark):
    rng = random.Random(8)
    words = ["fine", "good", "kind", "calm", "plain", "awful", "vile"]
    rows, labels = [], []
    for k in range(3000):
        bad = rng.random() < 0.1
        rows.append((k, " ".join(rng.choice(words[4:] if bad and rng.random() < 0.9 else words[:5]) for _ in range(10))))
        labels.append((k, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")
    for module, most in ((toxicity, 0.04), (quality, 0.04)):
        a, b = ({r.doc_id: r.score for r in module.score(docs, module.learn(docs, labels, rows=n)).collect()} for n in (3000, 1500))
        assert abs(np.mean(list(a.values())) - 0.1) < 0.02 and abs(np.mean(list(b.values())) - 0.1) < 0.02
        assert np.mean([abs(a[k] - b[k]) for k in a]) < most


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(k * 100, f"text {k}") for k in range(20)] + [(5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k // 100 % 2) for k in range(2000)], "doc_id long, label int")
    got = common.labelled_sample(docs, labels, 100, "label")
    assert len(got) == 20 and sum(y for _, y, _ in got) == 10 and abs(sum(w for _, _, w in got) - 20) < 1e-9


def test_classes_and_languages_of_long_texts_are_learned(spark):
    long = "wort und noch eines " * 20_000
    docs = spark.createDataFrame([(k, f"{k} {long}" if k % 2 else f"short text {k}", "de" if k % 2 else "en") for k in range(20)] + [(99, "12 34", "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, label int")
    got = common.labelled_sample(docs, labels, 20, "label")
    assert [y for _, y, _ in got] == [k % 2 for k in range(20)] and all(len(t) <= common.TRAIN_CHARS + common.TRAIN_PIECES for t, _, _ in got)
    assert language_id.learn(docs).languages == ["de", "en"]


def test_bounded_texts_reach_from_start_to_end(spark):
    text = "".join(chr(0x4E00 + k) for k in range(5000))
    got = spark.createDataFrame([(text,), (text[:64],), ("",), (None,)], "t string").select(common.bounded(F.col("t"), 64, 8).alias("b")).collect()
    assert got[1].b == text[:64] and got[2].b == "" and got[3].b is None
    parts = got[0].b.split(" ")
    assert len(parts) == 8 and parts[0] == text[:8] and parts[-1] == text[-8:] and all(p in text for p in parts)
