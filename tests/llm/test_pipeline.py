import corpus_pipeline
from lumenfold.llm import common, decontaminate, language_id, line_dedup, near_dedup
from pyspark.sql import functions as F

from .test_decontaminate import brute as contaminated
from .test_line_dedup import brute as clean_lines
from .test_near_dedup import brute as components
from .test_packing import check as packed


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    scratch = common.Scratch(spark, "test")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = scratch.save(stage(spark, docs, small), name)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            got = language_id.predict(docs, language_id.learn(docs), margin="m").collect()
            assert set(after) == {r.doc_id for r in got if r.lang_pred != "und" and r.m >= language_id.LEAST_MARGIN}
            assert len(after) >= 0.98 * len(before)
        elif name == "line_dedup":
            want = clean_lines(list(before.items()))
            assert after == {d: t for d, t in want.items() if t.strip() or t == before[d]}
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.text != before[r.doc_id])
        elif name == "minhash_near_dedup":
            want = components(list(before.items()), 5)
            assert set(after) == {d for d, (_, c) in want.items() if d == c}
        elif name == "benchmark_decontamination":
            hits = {d: contaminated(t, items, 13) for d, t in before.items()}
            assert set(after) == {d for d, (n, hit, _) in hits.items() if not (hit and 20 * len(hit) >= n)}
        else:
            packed(out.collect(), list(before.items()), 2048)
        docs = out


def test_run_and_empty_table(spark, small, tmp_path):
    assert corpus_pipeline.run(spark, small).count() > 100
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_components_of_long_chains(spark):
    scratch = common.Scratch(spark, "test")
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = common.connected_components(scratch, chain.union(spark.range(1).selectExpr("1000 + id", "999"))).collect()
    assert {r.id: r.component for r in got} == {**{k: 0 for k in range(301)}, 1000: 999, 999: 999}
    assert common.connected_components(scratch, chain.limit(0)).count() == 0


def test_modules_have_their_sizes():
    assert near_dedup.BANDS * near_dedup.ROWS == 96 and line_dedup.BANDS * line_dedup.SAMPLES == 48 and decontaminate.WINDOW == 13


def test_planted_junk_goes_and_other_columns_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    junk = {10**6: "qzxj vkwq " * 80, 10**6 + 1: "Это предложение написано на русском языке. " * 20, 10**6 + 2: "$$ 12 %% 34", 10**6 + 3: "这是一个句子" * 90}
    more = spark.createDataFrame([(k, t, None, "src0", len(t)) for k, t in junk.items()], docs.schema)
    docs = docs.unionByName(more)
    for c in ("__lang", "__doc", "__drop", "__removed", "__spans", "__n_words", "key", "near"):
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, common.Scratch(spark, "test").save(stage(spark, docs, small), name)
        assert docs.columns == before.columns
        if name == "language_id":
            assert not {r.doc_id for r in docs.collect()} & set(junk) and docs.count() >= 0.98 * (before.count() - 4)
    assert docs.where(" OR ".join(f"{c} <> '{c}'" for c in ("__lang", "__doc", "__drop", "__removed", "__spans", "__n_words", "key", "near"))).count() == 0
