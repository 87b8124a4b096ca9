import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import media, queries


def test_interleaving_keeps_order_and_captions():
    html = """<html><head><title>T</title><style>p{}</style></head><body>first <b>bold</b> words<p>second</p>
      <figure><figcaption>before it</figcaption><img src="sha256:aa"></figure><p>third<img src=b.png alt="an alt">fourth</p>
      <figure><img src="c"><img src="d"><figcaption>both &amp; each</figcaption></figure><script>var t="<img src=x>"</script><video src="v"></video> end"""
    got = [(i["kind"], i["text"] or i["src"], i["caption"]) for i in media.interleave(html)]
    assert got == [
        ("text", "T", None), ("text", "first bold words", None), ("text", "second", None), ("image", "sha256:aa", "before it"), ("text", "third", None), ("image", "b.png", "an alt"),
        ("text", "fourth", None), ("image", "c", "both & each"), ("image", "d", "both & each"), ("video", "v", None), ("text", "end", None),
    ]
    assert [i["position"] for i in media.interleave(html)] == list(range(len(got)))
    assert media.interleave(None) == [] and media.interleave("") == []
    assert [i["caption"] for i in media.interleave("<figure><img src=a><figcaption>open")] == ["open"]
    assert [i["text"] for i in media.interleave("<figcaption>alone</figcaption><p>x")] == ["alone", "x"]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_png_round_trip(n):
    payload, size = media.padded("é" * (n // 2) + "x" * (n % 2))
    stored = media.encode_png(payload)
    samples, width, height = media.decode_png(stored)
    assert samples.tobytes() == payload and (width, height) == (64, len(payload) // 64) and size == n
    assert len(payload) % 64 == 0 and len(payload) >= 64
    broken = bytearray(stored)
    broken[len(stored) // 2] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(broken))


def test_query_against_brute_force(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "abc"), (4, "abc"), (4, "abc"), (5, "é" * 40), (6, "long " * 50_000), (None, "abc")]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("digest", F.lit("d")).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_media_columns(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        text = dict(texts)[r.doc_id]
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.encode_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.features(np.frombuffer(payload, np.uint8).reshape(-1, 64)) and r.caption == f"{len(raw)} bytes"


def test_resolving_keeps_unknown_references(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:aa" alt="x"><img src="sha256:bb">'), (2, None), (3, "no media")], "page_id long, html string")
    known = spark.createDataFrame([("aa", 7)], "digest string, size int")
    got = media.resolve(media.sequences(pages), known).orderBy("position").collect()
    assert [(r.page_id, r.position, r.caption, r["size"]) for r in got] == [(1, 0, "x", 7), (1, 1, None, None)]
    assert media.resolve(media.sequences(pages.limit(0)), known).count() == 0


def test_resolving_keeps_order_beside_clashing_columns(spark, small):
    """Pages with several blocks and media each: every item keeps its place, source and caption, and meets its payload."""
    made = [f'<p>a{k}</p><figure><img src="sha256:{k % 5:02d}"><figcaption>c{k}</figcaption></figure><p>b</p><img src="sha256:{k % 3 + 3:02d}" alt="d{k}"><video src="v{k}.mp4"></video>' for k in range(30)]
    real = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    pages = spark.createDataFrame(list(enumerate(made + real)), "page_id long, html string")
    for c in ("position", "kind", "src", "caption", "item", "__item", "bytes"):
        pages = pages.withColumn(c, F.lit(c))
    known = spark.createDataFrame([(f"{k:02d}", 10 * k) for k in range(5)], "digest string, bytes int").withColumn("__source", F.lit("s"))
    out = media.resolve(media.sequences(pages), known)
    assert sorted(out.columns) == sorted(["page_id", "item", "__item", "position", "kind", "src", "caption", "digest", "bytes", "__source"])
    got = sorted((r.page_id, r.position, r.kind, r.src, r.caption, r.bytes) for r in out.collect())
    want = []
    for k, html in enumerate(made + real):
        for i in media.interleave(html):
            if i["kind"] != "text":
                digest = i["src"].removeprefix("sha256:")
                want.append((k, i["position"], i["kind"], i["src"], i["caption"], 10 * int(digest) if i["src"].startswith("sha256:0") and int(digest) < 5 else None))
    key = lambda x: (x[0], x[1])
    assert sorted(got, key=key) == sorted(want, key=key) and [g[1] for g in got if g[0] == 7] == [1, 3, 4]
